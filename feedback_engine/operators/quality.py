"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import count_if, percent


def coverage(records: DataFrame, flag: str, level: str) -> DataFrame:
    """Records, those with a flag, their share, and a count of each confidence level."""
    base = records.agg(F.count("*").alias("total"), count_if(F.col(flag)).alias("covered"))
    levels = records.groupBy(F.coalesce(level, F.lit("none")).alias("level")).agg(F.count("*").alias("n"))
    return levels.crossJoin(F.broadcast(base)).select("level", "n", "total", "covered", percent(F.col("covered"), F.col("total")).alias("covered_pct"))  # base is one row


def misaligned(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two tables, or is missing in one."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    return a.join(b, key, "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def unmatched(df: DataFrame, column: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Values that a dictionary lacks, whatever their case, most frequent first."""
    known = dictionary.select(F.lower(name).alias("_key")).distinct()
    return df.withColumn("_key", F.lower(column)).join(known, "_key", "left_anti").groupBy(column).agg(F.count("*").alias("n"))


def change_effect(df: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct values before and after, rows changed, and the reduction in percent."""
    one = df.agg(F.count_distinct(before).alias("before"), F.count_distinct(after).alias("after"), count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"))
    return one.withColumn("reduction_pct", percent(F.col("before") - F.col("after"), F.col("before")))
