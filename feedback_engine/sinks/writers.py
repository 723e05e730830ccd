"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.operators.scan import placed


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header and a fixed order of columns; others are left out."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def jsonl(df: DataFrame, path: str, by: Sequence[str] = (), append: bool = True) -> None:
    """JSON lines in a folder for each value of `by`."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def merged(df: DataFrame, key: str, order: Sequence[str], path: str) -> None:
    """One row for each key, sorted, as JSON lines."""
    from feedback_engine.operators.shape import deduplicated

    deduplicated(df, key, order).orderBy(*order, key).write.mode("overwrite").json(path)


def swapped(df: DataFrame, path: str) -> None:
    """Overwrite a table that may also be df's input: write beside it, then put it in the old one's place."""
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.new"
    df.write.parquet(staged)
    put(df.sparkSession, staged, path)


def put(spark: SparkSession, staged: str, path: str) -> None:
    """Rename what is at `path` away, then what is staged into its place.

    What was there is deleted last and comes back if the new one cannot take its
    place, so a whole one is there after a crash at any point: at `path`, or beside
    it under a name that ends in .old or the staged one.
    """
    kept = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.old"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(kept)
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"cannot rename {path}")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"cannot rename {staged}")
    fs.delete(aside, True)


def envelope(df: DataFrame, metadata: Mapping[str, object]) -> DataFrame:
    """Lines of a JSON document with metadata around the rows; for results that are read as one file."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("json"))
    meta = df.sparkSession.createDataFrame([(str(k), str(v)) for k, v in metadata.items()], "key string, value string") if metadata else None
    out = rows.select(F.lit("row").alias("part"), "json")
    if meta is None:
        return out
    return meta.select(F.lit("meta").alias("part"), F.to_json(F.struct("key", "value")).alias("json")).unionByName(out)


def document(df: DataFrame, path: str, metadata: Mapping[str, object], key: str = "rows", order: Sequence[str] = ()) -> None:
    """One JSON document {metadata..., key: [rows]} as text files in a folder, which are the document one after the other by name.

    Rows are sorted by ranges and written by as many tasks as they need; none sees
    them all. The folder takes its place when all of it is written.
    """
    import json

    spark, staged = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.new"
    head = json.dumps(dict(metadata), ensure_ascii=False)
    head = f"{head[:-1]}{', ' if metadata else ''}{json.dumps(key)}: ["
    columns = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = placed(df, [F.asc(c) for c in order], "_place") if order else df.withColumn("_place", F.monotonically_increasing_id() + 1)
    first = rows.agg(F.min("_place")).first()[0]
    lines = rows.select("_place", F.concat(F.when(F.col("_place") > first, ",").otherwise(""), F.to_json(columns)).alias("value"))
    ends = spark.createDataFrame([(0, head), ((1 << 62), "]}")], "_place long, value string")
    ends.unionByName(lines).orderBy("_place").select("value").write.text(staged)
    put(spark, staged, path)


def dashboard(results: Mapping[str, DataFrame], path: str) -> None:
    """A parquet table for each key of the dashboard."""
    for key, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{key}")


def assembled(spark: SparkSession, path: str, keys: Sequence[str], rows: int = 100_000) -> str:
    """The dashboard tables of a folder as one JSON text. They are top lists and totals; a larger one is refused."""
    import json

    out = {}
    for key in keys:
        df = spark.read.parquet(f"{path}/{key}")
        lines = df.select(F.to_json(F.struct(*df.columns)).alias("json")).limit(rows + 1).collect()
        if len(lines) > rows:
            raise ValueError(f"{key} has over {rows} rows; it is no dashboard table")
        out[key] = [json.loads(r["json"]) for r in lines]
    return json.dumps(out, ensure_ascii=False, sort_keys=True)
