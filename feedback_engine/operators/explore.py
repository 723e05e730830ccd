"""What the pages of a dashboard ask of its tables: a season or all, noise hidden or shown, a selector, a timeline, a link."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import parse_qs, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATEST, ALL = "latest", "all"


def in_period(df: DataFrame, period: object = LATEST, column: str = "ord") -> DataFrame:
    """Rows of one period: the last that is present, any other by its value, or all of them."""
    if period == ALL:
        return df
    if period != LATEST:
        return df.filter(F.col(column) == F.lit(period))
    last = df.agg(F.max(column).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(column) == F.col("_last")).drop("_last")  # one row


def revealed(df: DataFrame, columns: Sequence[str], least: int = 1, show_all: bool = False) -> DataFrame:
    """Rows whose columns add up to `least` or more; all rows if they are to be shown."""
    if show_all:
        return df
    total: Column = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return df.filter(total >= least)


def selector(df: DataFrame, group: str, option: str) -> DataFrame:
    """group, options: the distinct options of each group in alphabetical order. A dimension, so a group is a list that a page shows."""
    return df.filter(F.col(option).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(option)).alias("options"))


def entity_timeline(changes: DataFrame, counts: DataFrame, entity: str | None = None) -> DataFrame:
    """entity, ord, changes, and the counts' own columns, for each period in which an entity (or one of all) was changed or spoken of.

    changes: a row for each change (entity, ord); counts: a row for each (entity, ord).
    """
    if entity is not None:
        changes, counts = changes.filter(F.col("entity") == entity), counts.filter(F.col("entity") == entity)
    per = changes.groupBy("entity", "ord").agg(F.count("*").alias("changes"))
    both = per.join(counts, ["entity", "ord"], "full")
    return both.select("entity", "ord", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in both.columns if c not in ("entity", "ord")])


def link(url: str) -> tuple[str, dict[str, str]]:
    """The page and the parameters of a link such as #patch-notes?entity=CL-40."""
    page, _, query = url.partition("#")[2].partition("?")
    return unquote(page), {k: v[-1] for k, v in parse_qs(query, keep_blank_values=True).items()}


def linked(df: DataFrame, url: str, columns: dict[str, str]) -> DataFrame:
    """Rows that a link's parameters ask for; columns: by parameter. Others are ignored, and so are empty ones."""
    for name, value in link(url)[1].items():
        if name in columns and value:
            df = df.filter(F.col(columns[name]).cast("string") == value)
    return df
