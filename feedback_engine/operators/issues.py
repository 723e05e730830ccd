"""Operators on issues, entities and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import change_percent, count_if, percent
from feedback_engine.operators.rank import top_per_group
from feedback_engine.operators.scan import placed


def ranked_by_kind(issues: DataFrame, groups: list[str], caps: dict[str, int]) -> DataFrame:
    """The most frequent texts of each kind in each group, with the votes they got."""
    rows = issues.groupBy(*groups, "kind", "text").agg(F.count("*").alias("n"), F.sum("votes").cast("long").alias("votes"))
    limit = F
    for kind, n in caps.items():
        limit = limit.when(F.col("kind") == kind, n)
    return top_per_group(rows, [*groups, "kind"], [F.desc("n"), F.asc("text")], max(caps.values())).filter(F.col("rank") <= limit.otherwise(0))


def stats(issues: DataFrame, kinds: tuple[str, ...] = ("complaint", "suggestion", "praise")) -> DataFrame:
    """Totals and distinct texts of all issues and of each kind: texts and records are grouped once each, no row is multiplied."""
    of = [count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    texts = issues.groupBy("text").agg(F.count("*").alias("n"), *of)
    own = F.col("text").isNotNull()
    per = [F.coalesce(F.sum(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds] + [count_if(own & (F.col(f"n_{k}") > 0)).alias(f"distinct_{k}") for k in kinds]
    one = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_issues"), count_if(own).alias("distinct_texts"), *per)
    records = issues.select("rec_id").distinct().agg(F.count("rec_id").alias("n_records"))
    return one.crossJoin(F.broadcast(records)).select("n_issues", "n_records", "distinct_texts", *[f"n_{k}" for k in kinds], *[f"distinct_{k}" for k in kinds])  # one row


def by_language_and_tag(complaints: DataFrame, tagged: DataFrame, least: int = 5, least_tag: int = 3, top: int = 10, top_tag: int = 5) -> DataFrame:
    """Top complaint texts of each language, and of each tag in it.

    complaints: rec_id, language, text; tagged: rec_id, tag. A text counts once
    for each tag of its record. Languages whose best text is rarer than `least`
    go, and tags whose best is rarer than `least_tag`.
    """
    own = complaints.filter(F.col("language") != "")
    # A complaint counts for "_all" and for each tag of its record: one join, one aggregation.
    sets = tagged.groupBy("rec_id").agg(F.collect_set("tag").alias("tags"))
    each = own.join(sets, "rec_id", "left").select("language", "text", F.explode(F.concat(F.array(F.lit("_all")), F.coalesce("tags", F.array().cast("array<string>")))).alias("tag"))
    rows = each.groupBy("language", "tag", "text").agg(F.count("*").alias("n"))
    heard = rows.filter(F.col("tag") == "_all").groupBy("language").agg(F.max("n").alias("best")).filter(F.col("best") >= least).select("language")
    rows = rows.join(heard, "language", "left_semi")
    ranked = top_per_group(rows, ["language", "tag"], [F.desc("n"), F.asc("text")], top)
    first = F.first("n").over(Window.partitionBy("language", "tag").orderBy("rank"))
    ranked = ranked.withColumn("_first", first)
    return ranked.filter((F.col("tag") == "_all") | (F.col("_first") >= least_tag) & (F.col("rank") <= top_tag)).select("language", "tag", "text", "n", "rank")


def prefixes(df: DataFrame, column: str, name: str = "prefix", least: int = 1) -> DataFrame:
    """df with a row for each prefix of a text, from `least` characters to the whole."""
    n = F.length(column)
    lengths = F.when(n >= least, F.sequence(F.lit(least), n)).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.explode(lengths).alias("_n")).withColumn(name, F.expr(f"left({column}, _n)")).drop("_n")


def matched_entities(items: DataFrame, entities: DataFrame) -> DataFrame:
    """items (item) with the entity it names: the same, else the most frequent of which it is a prefix or which is a prefix of it.

    entities (entity, total) may be a table of any size: either side's prefixes
    are joined by equality, so nothing is compared with everything. Of entities
    that share a prefix only the best travels. An empty text names nothing; equal
    totals go to the smaller entity.
    """
    names = entities.filter(F.length("entity") > 0).groupBy("entity").agg(F.max("total").alias("total"))
    wanted = items.select("item").distinct().filter(F.length("item") > 0)
    score = F.struct((-F.col("total")).alias("minus"), F.col("entity").alias("entity"))
    longer = prefixes(names, "entity", "item").groupBy("item").agg(F.min(score).alias("best")).join(wanted, "item", "left_semi")
    within = prefixes(wanted, "item", "entity").join(names, "entity").select("item", score.alias("best"))
    both = within.unionByName(longer).select("item", F.struct((F.col("best.entity") != F.col("item")).alias("other"), F.col("best")).alias("m"))
    best = both.groupBy("item").agg(F.min("m").alias("m"))
    return items.join(best.select("item", F.col("m.best.entity").alias("entity")), "item", "left")


def impact(changes: DataFrame, complaints: DataFrame) -> DataFrame:
    """changes (change_id, entity, ord) with the entity's complaints in the period before and in its own.

    complaints: entity, ord, n.
    """
    before = complaints.select("entity", (F.col("ord") + 1).alias("ord"), F.col("n").alias("before"))
    after = complaints.select("entity", "ord", F.col("n").alias("after"))
    both = changes.join(before, ["entity", "ord"], "left").join(after, ["entity", "ord"], "left")
    both = both.withColumns({"before": F.when(F.col("ord") > 0, F.coalesce("before", F.lit(0))), "after": F.coalesce("after", F.lit(0))})
    return both.withColumn("delta_pct", change_percent(F.col("after"), F.col("before")))


def distribution(issues: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of each text over a key's values, a column for each."""
    return issues.groupBy("text").agg(F.count("*").alias("n"), *[count_if(F.col(key) == v).alias(f"n_{i}") for i, v in enumerate(values)])


def change_log_stats(patches: DataFrame) -> DataFrame:
    """Patches (balance_changes array), their changes, and patches with a change."""
    n = F.coalesce(F.size("balance_changes"), F.lit(0))
    return patches.agg(F.count("*").alias("patches"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("changes"), count_if(n > 0).alias("with_changes"))


def extraction_stats(records: DataFrame) -> DataFrame:
    """Of records (rec_id, n issues, p primary ones; null without any): issues, issues a record, primary ones, and records without an issue."""
    n, p = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "p"))
    out = records.agg(n.cast("long").alias("n_issues"), F.count("*").alias("n_records"), F.round(F.try_divide(n.cast("double"), F.count("*").cast("double")), 2).alias("per_record"), p.cast("long").alias("n_primary"), count_if(F.col("n").isNull()).alias("n_empty"))
    return out.withColumn("empty_pct", percent(F.col("n_empty"), F.col("n_records")))


def ordered_log(log: DataFrame, date: str, version: str) -> DataFrame:
    """A change log with each entry's place by date, entries without a date last; of any size, no task sorts it whole."""
    return placed(log, [F.asc_nulls_last(date), F.asc(version)])


def spikes(daily: DataFrame, day: str = "day", value: str = "negative", days: int = 14, factor: float = 3.0, least: int = 10) -> DataFrame:
    """Days whose value is `factor` times the mean of the days before, and `least` at least. daily has a row for each day."""
    w = Window.orderBy(day).rowsBetween(-days, -1)
    rows = daily.withColumn("usual", F.avg(value).over(w))
    return rows.filter((F.col(value) >= least) & (F.col(value) >= factor * F.col("usual")))
