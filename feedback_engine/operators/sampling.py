"""Reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int) -> Column:
    """An order that a seed fixes and other engines can compute."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def strided(df: DataFrame, key: str, step: int, seed: int = 0) -> DataFrame:
    """Every step-th key, from seed on."""
    return df.filter(F.pmod(F.col(key) - seed, F.lit(step)) == 0)


def stratified(candidates: DataFrame, group: str, stratum: str, key: str, text: str, target: int = 15, best: int = 20, seed: int = 42) -> DataFrame:
    """About `target` rows of each group, spread over its strata.

    A stratum offers its `best` rows: texts of 60 to 600 characters first, then
    by the seed's order. Each stratum present gets a slot; the others are dealt
    in proportion to the number of candidates, and what rounding leaves goes to
    the largest (ties: smaller name). Slots below 0 count as 0.
    """
    rows = candidates.filter(F.length(F.trim(F.col(text))) > 0)
    size = F.length(text)
    order = [F.desc(F.when((size >= 60) & (size <= 600), 1).otherwise(0)), F.asc("_order"), F.asc(key)]
    rows = rows.withColumn("_order", shuffled(F.col(key), seed))
    ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(group, stratum).orderBy(*order))).filter(F.col("pick") <= best)
    sizes = rows.groupBy(group, stratum).agg(F.count("*").alias("n"))
    whole, first = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc("n"), F.asc(stratum))
    sizes = sizes.withColumns({"total": F.sum("n").over(whole), "present": F.count("*").over(whole), "place": F.row_number().over(first)})
    share = (F.lit(1) + F.round(F.col("n").cast("double") / F.col("total") * (target - F.col("present")), 0)).cast("int")
    sizes = sizes.withColumn("slot", share)
    sizes = sizes.withColumn("slot", F.greatest(F.col("slot") + F.when(F.col("place") == 1, target - F.sum("slot").over(whole)).otherwise(0), F.lit(0)).cast("int"))
    return ranked.join(sizes.select(group, stratum, "slot"), [group, stratum]).filter(F.col("pick") <= F.col("slot")).drop("_order", "slot")
