"""Dimensions: seasons, categories, entities, aliases, literal series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.sources.readers import entity_dimension

# Average concurrent players by month.
MONTHLY_PLAYERS = {
    "2023-12": 242399, "2024-01": 116913, "2024-02": 49060, "2024-03": 48226, "2024-04": 27273, "2024-05": 20910, "2024-06": 31623, "2024-07": 16720, "2024-08": 16929,
    "2024-09": 29264, "2024-10": 24975, "2024-11": 21731, "2024-12": 23431, "2025-01": 18121, "2025-02": 19499, "2025-03": 27295, "2025-04": 20271, "2025-05": 19849,
    "2025-06": 28835, "2025-07": 19426, "2025-08": 25801, "2025-09": 32758, "2025-10": 24326, "2025-11": 16742, "2025-12": 12835, "2026-01": 11969, "2026-02": 11872,
}


def monthly_players(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MONTHLY_PLAYERS.items()), "month string, players long")


def seasons(spark: SparkSession, path: str) -> DataFrame:
    """(ord, season, start_ts, end_ts) of a JSON list of {season, start, end}; ord follows the start."""
    rows = spark.read.option("multiLine", True).schema("season string, start string, end string").json(path)
    at = lambda c: F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd"))
    listed = rows.orderBy("start").collect()  # a dimension of a few rows
    order = spark.createDataFrame([(i, r["season"], r["start"], r["end"]) for i, r in enumerate(listed)], "ord int, season string, start string, end string")
    return order.select("ord", "season", at(F.col("start")).alias("start_ts"), at(F.col("end")).alias("end_ts"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(sentiment, category, description) of a JSON object {negative: {name: text}, positive: {...}}."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    sides = one.select(F.explode("m").alias("sentiment", "c"))
    return sides.select("sentiment", F.explode("c").alias("category", "description"))


def entities(spark: SparkSession, groups: dict[str, dict[str, list[str]]]) -> DataFrame:
    return entity_dimension(spark, groups)


def aliases(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """(alias, canonical, ambiguous): an alias is ambiguous if it stands for several names or depends on context."""
    rows = spark.createDataFrame(list(names.items()), "alias string, canonical string")
    return rows.withColumn("ambiguous", F.col("canonical").contains(" or ") | (F.col("canonical") == "context-dependent"))


def canonical_names(entity: DataFrame, alias: DataFrame) -> DataFrame:
    """(name): every known name, in lower case: entities, and aliases that are not ambiguous."""
    known = entity.select(F.lower("entity").alias("name"))
    return known.union(alias.filter(~F.col("ambiguous")).select(F.lower("canonical"))).distinct()
