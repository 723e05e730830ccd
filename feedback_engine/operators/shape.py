"""Cleaning and shaping of records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine.functions.text import stripped
from feedback_engine.operators.rank import first_per_key

#: Kinds of an issue; any other counts as the first.
KINDS = ("complaint", "suggestion", "praise")
ISSUE = "struct<text:string,type:string,entities:array<string>,primary:boolean,season_ref:string>"


def recoded(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values of each group replaced by the group's name."""
    out = F
    for name, values in groups.items():
        out = out.when(F.col(column).isin(*values), name)
    return df.withColumn(column, out.otherwise(F.col(column)) if groups else F.col(column))


def sentiment(voted_up: Column) -> Column:
    """positive unless the vote is down; a missing vote counts as up."""
    return F.when(F.coalesce(voted_up, F.lit(True)), "positive").otherwise("negative")


def as_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")) == "true", F.lit(False))


def worth_processing(tags: Column, text: Column, least: int = 5) -> Column:
    """Tagged, or with a text that says something."""
    return F.coalesce((F.size(tags) > 0) | (F.length(stripped(text)) >= least), F.lit(False))


def sanitised(issues: Column, longest: int = 100, kinds: Sequence[str] = KINDS) -> Column:
    """Issues with a text; cut, of a known kind, with a list of entities and a boolean."""
    kept = F.filter(issues, lambda i: F.coalesce(i["text"], F.lit("")) != "")
    return F.transform(
        kept,
        lambda i: F.struct(
            F.substring(i["text"], 1, longest).alias("text"),
            F.when(i["type"].isin(*kinds), i["type"]).otherwise(kinds[0]).alias("type"),
            F.coalesce(i["entities"], F.array().cast("array<string>")).alias("entities"),
            F.coalesce(i["primary"], F.lit(False)).alias("primary"),
            i["season_ref"].alias("season_ref"),
        ),
    )


def model_reply(reply: Column, schema: str) -> Column:
    """A model's JSON reply, with or without a code fence, as `schema`; null if it is not JSON."""
    bare = F.regexp_replace(F.regexp_replace(stripped(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema)


def literal_struct(text: Column, schema: T.DataType | str) -> Column:
    """A struct written as a Python literal (single quotes, True, False, None) or as JSON."""
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.from_json(json, schema, {"allowSingleQuotes": "true"})


def deduplicated(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; rows without a key go."""
    return first_per_key(df, key, [F.asc_nulls_last(c) for c in order])


def merged_results(records: DataFrame, results: DataFrame, key: str, version: str, defaults: Mapping[str, Column], ties: Sequence[Column] = ()) -> DataFrame:
    """records with the latest result of each key, or the defaults; of several results of one version the first by ties."""
    latest = first_per_key(results, key, [F.desc(version), *ties])
    return records.join(latest.select(key, *defaults), key, "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def pending(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records without a result yet."""
    return records.join(done.select(key), key, "left_anti")


def upserted(base: DataFrame, update: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every key of either side; update's values, and base's where update has none."""
    a, b = base.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns]), update.select(key, *columns)
    return b.join(a, key, "full").select(key, *[F.coalesce(c, f"_old_{c}").alias(c) for c in columns])
