"""Counting, top-N and running windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import percent


def counted(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Spark limits each task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_counts(df: DataFrame, groups: Sequence[str], key: str, n: int, name: str = "n") -> DataFrame:
    """The n most frequent keys of each group, ties to the smaller key."""
    return top_per_group(counted(df, *groups, key, name=name), groups, [F.desc(name), F.asc(key)], n)


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of all; each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def with_share(df: DataFrame, groups: Sequence[str], value: str = "n", name: str = "pct") -> DataFrame:
    """value as percent of its group's sum."""
    return df.withColumn(name, percent(F.col(value), F.sum(value).over(Window.partitionBy(*groups))))


def first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in order. Rows without a key go."""
    return top_per_group(df.filter(F.col(key).isNotNull()), [key], order, 1, "_first").drop("_first")


def moving_average(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, rows: int, name: str = "moving_avg") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(w))


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, name: str = "running") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
