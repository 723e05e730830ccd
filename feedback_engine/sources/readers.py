"""Readers of reviews, dimensions and progress files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.operators.shape import literal_struct

AUTHOR = "struct<steamid:string,personaname:string,playtime_forever:long,playtime_at_review:long>"
REVIEW = (
    f"recommendationid string, author {AUTHOR}, voted_up boolean, language string, review string, timestamp_created long, timestamp_updated long, "
    "votes_up long, votes_funny long, weighted_vote_score string, comment_count long, steam_purchase boolean, received_for_free boolean, "
    "written_during_early_access boolean, primarily_steam_deck boolean"
)


def jsonl(spark: SparkSession, path: str, schema: str = REVIEW) -> DataFrame:
    """One record a line; malformed lines go, and so do lines of nothing."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def document(spark: SparkSession, path: str, element: str = REVIEW, field: str = "reviews") -> DataFrame:
    """A JSON document that is a list, or an object with the list in a field."""
    text = spark.read.text(path, wholetext=True)
    bare, inside = F.from_json("value", f"array<struct<{_struct(element)}>>"), F.from_json("value", f"struct<{field}:array<struct<{_struct(element)}>>>")
    rows = F.when(F.ltrim(F.col("value")).startswith("["), bare).otherwise(inside[field])
    return text.select(F.inline(rows))


def _struct(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def with_author(df: DataFrame) -> DataFrame:
    """author as a struct, also where it was written as a Python literal."""
    if dict(df.dtypes)["author"] != "string":
        return df
    return df.withColumn("author", literal_struct(F.col("author"), AUTHOR))


def flattened(df: DataFrame) -> DataFrame:
    """The flat export: nested author, hours instead of minutes, times as text."""
    from feedback_engine.functions.time import from_epoch

    hours = lambda c: F.round(F.coalesce(F.col(f"author.{c}"), F.lit(0)) / 60, 1)
    plain = [c for c in ("recommendationid", "voted_up", "language", "review", "votes_up", "votes_funny", "weighted_vote_score", "comment_count", "steam_purchase", "received_for_free", "written_during_early_access", "primarily_steam_deck") if c in df.columns]
    return df.select(
        *plain, F.col("author.steamid").alias("steamid"), F.col("author.personaname").alias("personaname"), hours("playtime_forever").alias("hours_forever"), hours("playtime_at_review").alias("hours_at_review"),
        from_epoch(F.col("timestamp_created")).alias("created"), from_epoch(F.col("timestamp_updated")).alias("updated"),
    )


def entity_dimension(spark: SparkSession, groups: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(entity, class, type) of nested lists {type: {class: [names]}}; the last class that lists a name has it."""
    rows = {name: (name, cls, kind) for kind, classes in groups.items() for cls, names in classes.items() for name in names}
    return spark.createDataFrame(list(rows.values()), "entity string, class string, type string")
