"""Shared helpers: the shared folder, written intermediate tables, row hygiene."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of the text contracts.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master without it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _folders.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _folders[-1]


def cleaned(spark: SparkSession) -> None:
    """Remove every intermediate table that this process has written; call it when no result that reads them is needed any more."""
    dropped(spark, *_folders)
    _folders.clear()


def mark() -> int:
    """The point that settled() goes back to."""
    return len(_folders)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df written, and every intermediate table of this process since the mark removed; for results much smaller than what they come from."""
    out = written(df, name)
    dropped(df.sparkSession, *_folders[since:-1])
    del _folders[since:-1]
    return out


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: df as a parquet table in the shared folder, which outlives any executor."""
    path = path or new_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in filter(None, paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def folder_of(df: DataFrame) -> str:
    """The folder of a table made by written()."""
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""


HEAVY = 1024


def met(big: DataFrame, small: DataFrame, on: str | list[str], n: str, total: int, how: str = "inner", only: Column | None = None) -> DataFrame:
    """big joined (inner or left) with small on the columns `on`, of which small has each value once, and in its column n how many of big's `total` rows have it.

    Values with more than 1 / HEAVY of the rows, so fewer than HEAVY of them, are dealt into parts of about that size: rows by their other
    columns' hash, small's row once for each part. The list of these values is broadcast; its bound holds whatever the tables. With `only`, a condition on small, an inner join is with its rows that meet it, and no
    row of big with a frequent other value travels.
    """
    on = [on] if isinstance(on, str) else on
    share = max(total // HEAVY, 1000)
    parts = F.ceil(F.col(n) / share).cast("int")
    heavy = small.filter(F.col(n) > share).select(*on, (parts if only is None else F.when(only, parts).otherwise(0)).alias("_parts"))
    small = small if only is None else small.filter(only)
    others = [c for c in big.columns if c not in on]
    part = F.coalesce(F.pmod(F.xxhash64(*others), F.col("_parts")), F.lit(0)).cast("int")
    dealt = big.join(F.broadcast(heavy), on, "left").filter(F.coalesce("_parts", F.lit(1)) > 0).withColumn("_part", part).drop("_parts")
    copied = small.withColumn("_part", F.explode(F.when(F.col(n) > share, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))).drop(n)
    return dealt.join(copied, [*on, "_part"], how).drop("_part")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python in batches of `rows`, unless the session says otherwise; the default of 10 000 holds ten times the memory."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
