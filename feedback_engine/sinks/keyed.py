"""A table with one row for each key that is merged into again and again.

Keys are dealt into buckets by their hash. A merge rewrites only the buckets that
its rows fall into, beside the old files, and then names them in a new manifest.
Readers take the manifest of the highest number, which is put there by a rename,
so they see all of a merge or nothing of it; a merge that ends early leaves files
that no manifest names. Merging the same rows again, or in another order, gives
the same table: the row of the highest version stays, among equals the one whose
values hash highest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


class KeyedTable:
    """path: a folder; key, version: columns. Without a version the row that was there first stays. The number of buckets is fixed by the first merge."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets

    def _hadoop(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf), where

    def manifests(self) -> list[int]:
        fs, where = self._hadoop(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()) if fs.exists(where) else []

    def manifest(self) -> dict:
        """number, schema, buckets and files (folder by bucket) as of the last merge; empty before the first."""
        found = self.manifests()
        if not found:
            return {"number": -1, "files": {}, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first()[0]
        return json.loads(text) | {"number": found[-1]}

    def _swapped(self, manifest: dict, number: int) -> None:
        fs, staged = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(self._hadoop(f"{self.path}/manifest/{number}")[1]) or not fs.rename(staged, self._hadoop(f"{self.path}/manifest/{number}")[1]):
            fs.delete(staged, False)
            raise OSError(f"another merge has written manifest {number} of {self.path}")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        files = [f for b, f in manifest["files"].items() if buckets is None or int(b) in buckets]
        if "schema" not in manifest:
            return None
        schema = manifest["schema"]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        found = self._read(self.manifest())
        if found is None:
            raise ValueError(f"nothing has been merged into {self.path}")
        return found

    def merge(self, rows: DataFrame) -> int:
        """Merge rows (of the same columns each time) and return how many buckets were written. Rows without a key go. rows are read twice, so they should be a table or persisted."""
        old = self.manifest()
        dealt = rows.filter(F.col(self.key).isNotNull()).withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(old["buckets"])).cast("int"))
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # at most `buckets`
        if not touched and old["number"] >= 0:
            return 0
        kept = self._read(old, touched)
        every = dealt.withColumn("_new", F.lit(True))
        if kept is not None:
            kept = kept.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(old["buckets"])).cast("int"))
            every = every.unionByName(kept.withColumn("_new", F.lit(False)))
        values = F.xxhash64(*[c for c in rows.columns])
        order = [F.desc_nulls_last(self.version), F.desc(values)] if self.version else [F.asc("_new"), F.desc(values)]
        latest = every.withColumn("_rank", F.row_number().over(Window.partitionBy(BUCKET, self.key).orderBy(*order))).filter("_rank = 1")
        once = f"data/{uuid.uuid4().hex[:12]}"
        latest.select(*rows.columns, BUCKET).repartition(max(len(touched), 1), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{once}")
        files = old["files"] | {str(b): f"{once}/{BUCKET}={b}" for b in touched}
        self._swapped({"schema": _ddl(rows), "buckets": old["buckets"], "files": files}, old["number"] + 1)
        return len(touched)

    def cleaned(self, keep: int = 2) -> None:
        """Remove manifests but the last `keep`, and files that none of these names; not while a merge runs."""
        fs, _ = self._hadoop(self.path)
        for n in self.manifests()[:-keep]:
            fs.delete(self._hadoop(f"{self.path}/manifest/{n}")[1], False)
        named = {f for n in self.manifests() for f in json.loads(self.spark.read.text(f"{self.path}/manifest/{n}", wholetext=True).first()[0])["files"].values()}
        where = self._hadoop(f"{self.path}/data")[1]
        for s in fs.listStatus(where) if fs.exists(where) else []:
            for part in fs.listStatus(s.getPath()):
                name = f"data/{s.getPath().getName()}/{part.getPath().getName()}"
                if name not in named:
                    fs.delete(part.getPath(), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
