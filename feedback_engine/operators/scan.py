"""Places and running totals over all rows of a table, without a task that sees them all.

A window without a partition sorts everything in one task. Here rows are dealt by
range, each range is sorted by itself, and what comes before a range is a sum
over the ranges' totals, of which there are as many as partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_engine.session import shared_folder

#: Spark's ids hold the partition above these bits and the place in it below.
PLACE_BITS = 33
_folders: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, so ranges are the same whoever reads them, also after a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    _folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleaned(spark: SparkSession) -> None:
    """Remove every table that this process has written here; call it when no result that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        where = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        where.getFileSystem(conf).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order: Sequence[Column], parts: int | None) -> DataFrame:
    """df written in order, with _part and _at, its place in it; rows equal in order go by their other columns, and equal rows need not meet in a task."""
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    out = df.withColumns({"_tie": F.xxhash64(*plain), "_copy": F.monotonically_increasing_id()})
    keys = [*order, F.col("_tie"), F.col("_copy")]
    out = out.repartitionByRange(parts or partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie", "_copy")
    out = written(out.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return out.withColumns({"_part": F.shiftright("_at", PLACE_BITS), "_at": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})


def _before(totals: DataFrame, *names: str) -> DataFrame:
    """Of each _part, the sums of the parts before it; totals has a row for each part."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in names])


def placed(df: DataFrame, order: Sequence[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """df with each row's place in order, from 1, as a long: row_number over the whole table."""
    rows = _ranged(df, order, parts)
    before = _before(rows.groupBy("_part").agg(F.count("*").alias("n")), "n")
    out = rows.join(F.broadcast(before), "_part")  # a row for each partition
    return out.select(*df.columns, (F.col("_before_n") + F.col("_at") + 1).alias(name))


def running(df: DataFrame, order: Sequence[Column], value: str, name: str = "running", place: str = "place", parts: int | None = None) -> DataFrame:
    """df with its place and the sum of value up to and with each row, over the whole table; nulls add nothing. The sums are those of a window with rows, not of ranges: rows equal in order count one after the other."""
    rows = _ranged(df, order, parts)
    before = _before(rows.groupBy("_part").agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("v")), "n", "v")
    own = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_own", own).join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_before_n") + F.col("_at") + 1).alias(place), (F.col("_before_v") + F.col("_own")).alias(name))


def last_known(df: DataFrame, order: Sequence[Column], value: str, parts: int | None = None) -> DataFrame:
    """df with nulls of value filled by the last value before them in order, over the whole table; null where there is none."""
    rows = _ranged(df, order, parts)
    own = F.last(value, True).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    each = rows.groupBy("_part").agg(F.max(F.when(F.col(value).isNotNull(), F.struct("_at", F.col(value).alias("v")))).alias("last"))
    before = each.select("_part", F.last("last.v", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    out = rows.withColumn("_own", own).join(F.broadcast(before), "_part")  # a row for each partition
    return out.select(*[F.coalesce("_own", "_before").alias(c) if c == value else F.col(c) for c in df.columns])


def with_progress(df: DataFrame, order: Sequence[Column], value: str, name: str = "running") -> DataFrame:
    """running(), with the place and the running sum in percent of the whole."""
    from feedback_engine.functions.numbers import percent

    out = running(df, order, value, name)
    total = df.agg(F.count("*").alias("_rows"), F.coalesce(F.sum(value), F.lit(0)).alias("_all"))
    both = out.crossJoin(F.broadcast(total))  # one row
    return both.withColumns({"rows_pct": percent(F.col("place"), F.col("_rows")), f"{name}_pct": percent(F.col(name), F.col("_all"))}).drop("_rows", "_all")
