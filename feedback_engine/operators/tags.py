"""Operators on multi-valued tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import count_if, percent
from feedback_engine.operators.rank import counted


def exploded(df: DataFrame, tags: str = "tags", name: str = "tag") -> DataFrame:
    """A row for each tag; rows without one go."""
    return df.withColumn(name, F.explode(tags)).drop(tags)


def allowed(df: DataFrame, tags: str, names: Sequence[str]) -> DataFrame:
    """Tags that are allowed, in order and with repeats, and how many were not."""
    ok = F.filter(tags, lambda t: t.isin(*names))
    return df.withColumns({"kept": ok, "violations": (F.size(tags) - F.size(ok)).cast("long")})


def cooccurrence(df: DataFrame, key: str, tag: str, least: int = 500) -> DataFrame:
    """Pairs of tags that records share: how many, and in percent of each tag's records.

    Pairs are made within each record's own set of tags, which is small; the
    counts combine before the shuffle.
    """
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(tag)).alias("s"))
    pair = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    pairs = sets.select(F.explode(pair).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = sets.select(F.explode("s").alias("tag")).groupBy("tag").agg(F.count("*").alias("total"))
    a, b = totals.select(F.col("tag").alias("tag_a"), F.col("total").alias("a")), totals.select(F.col("tag").alias("tag_b"), F.col("total").alias("b"))
    return pairs.join(a, "tag_a").join(b, "tag_b").select("tag_a", "tag_b", "n", percent(F.col("n"), F.col("a")).alias("pct_a"), percent(F.col("n"), F.col("b")).alias("pct_b"))


def deviation(records: DataFrame, tagged: DataFrame, group: str = "language", least: int = 50, top: int = 10, points: float = 3.0) -> DataFrame:
    """Where a group's share of a frequent tag differs from the whole by `points` or more.

    The frequent tags are `top` rows, so pairing groups with them is bounded.
    """
    every, own = counted(records, group, name="total"), counted(tagged, group, "tag", name="own_n")
    # Totals come from the groups' counts, so records and tags are each aggregated once.
    overall = every.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("all"))
    groups = every.filter(F.col("total") >= least)
    common = own.groupBy("tag").agg(F.sum("own_n").alias("tag_n")).orderBy(F.desc("tag_n"), "tag").limit(top).crossJoin(overall)
    grid = groups.crossJoin(F.broadcast(common)).join(own, [group, "tag"], "left")
    share, base = F.col("own_n") / F.col("total") * 100, F.col("tag_n") / F.greatest(F.col("all"), F.lit(1)) * 100
    grid = grid.withColumns({"share": F.coalesce(share, F.lit(0.0)), "base": base}).filter(F.abs(F.col("share") - F.col("base")) >= points)
    return grid.select(group, "tag", F.round("share", 1).alias("share"), F.round("base", 1).alias("base"), F.round(F.col("share") - F.col("base"), 1).alias("diff"))


def recurring(tagged: DataFrame, period: str = "season", least: int = 3) -> DataFrame:
    """Tags that occur in `least` periods or more."""
    return tagged.groupBy("tag").agg(F.count_distinct(period).alias("periods")).filter(F.col("periods") >= least)


def backfilled(records: DataFrame, issues: DataFrame, mapping: DataFrame) -> DataFrame:
    """records (rec_id, sentiment, tags) whose empty tags are inferred from their issues (rec_id, topic) by mapping (sentiment, topic, tag)."""
    inferred = records.filter(F.size("tags") == 0).select("rec_id", "sentiment").join(issues.select("rec_id", "topic").distinct(), "rec_id").join(mapping, ["sentiment", "topic"])
    inferred = inferred.groupBy("rec_id").agg(F.array_sort(F.collect_set("tag")).alias("inferred"))
    return records.join(inferred, "rec_id", "left").withColumn("tags", F.when((F.size("tags") == 0) & F.col("inferred").isNotNull(), F.col("inferred")).otherwise(F.col("tags"))).drop("inferred")


def backfilled_by(records: DataFrame, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """backfilled() for records that hold their topics as an array, and a mapping that is a literal list: no row travels for it."""
    by_pair: dict[str, list[str]] = {}
    for side, topic, tag in mapping:
        by_pair.setdefault(f"{side}\0{topic}", []).append(tag)
    if not by_pair:
        return records
    known = F.create_map(*[x for pair, names in by_pair.items() for x in (F.lit(pair), F.array(*map(F.lit, names)))])
    found = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(known, F.concat("sentiment", F.lit("\0"), t)), F.array().cast("array<string>")))
    inferred = F.array_sort(F.array_distinct(F.flatten(found)))
    return records.withColumn("tags", F.when(F.size("tags") == 0, inferred).otherwise(F.col("tags")))


def multi_tag_stats(df: DataFrame, tags: str = "tags") -> DataFrame:
    n = F.size(tags)
    return df.agg(F.count("*").alias("total"), count_if(n > 0).alias("tagged"), count_if(n == 0).alias("untagged"), count_if(n > 1).alias("multi"), F.coalesce(F.round(F.try_divide(F.sum(n).cast("double"), count_if(n > 0).cast("double")), 2), F.lit(0.0)).alias("per_tagged"))


def with_group_best(df: DataFrame, groups: Sequence[str], value: str, name: str = "best") -> DataFrame:
    """The largest value of each group beside each row."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*groups)))
