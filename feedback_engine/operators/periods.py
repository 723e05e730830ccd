"""Seasons: interval lookup, profiles and changes between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import change_percent, count_if, percent
from feedback_engine.operators.rank import top_per_group
from feedback_engine.operators.scan import last_known, placed

OUTSIDE = "Off-season"
#: Intervals that become one CASE expression; a larger table is looked up by its segments, by the same rule.
CASE_ROWS = 200
#: Levels of the interval tree whose nodes are broadcast: fewer than 2 ** (TOP + 1).
TOP = 10


def with_period(df: DataFrame, periods: DataFrame | Sequence[tuple], ts: str = "ts", outside: str = OUTSIDE, case_rows: int = CASE_ROWS) -> DataFrame:
    """df with ord and season of the first interval, by ord and then season, that holds ts; else null and `outside`.

    periods: rows (ord, season, start_ts, end_ts), as a table or, without a job to
    read it, as a list. Intervals are half-open, may overlap or touch, and are
    open on a side that is null; one that ends before it starts holds nothing. A
    small table becomes a CASE expression, so no row moves and no join is planned.
    A table of any other size is cut into segments that don't overlap, and each
    row takes the last segment that starts at or before it, by a scan over ranges:
    long intervals and frequent times do no harm. Both give the same rows.
    """
    if isinstance(periods, DataFrame):
        rows = [(r["ord"], r["season"], r["start_ts"], r["end_ts"]) for r in periods.orderBy("ord", "season").limit(case_rows + 1).collect()]
    else:
        rows = sorted(periods, key=lambda r: r[:2])
        periods = df.sparkSession.createDataFrame(rows, "ord int, season string, start_ts timestamp_ntz, end_ts timestamp_ntz") if len(rows) > case_rows else None
    if not rows:
        return df.withColumns({"ord": F.lit(None).cast("int"), "season": F.lit(outside)})
    if len(rows) <= case_rows:
        name, ord_ = F, F
        for i, label, start, end in rows:
            inside = F.col(ts).isNotNull()
            inside = inside if start is None else inside & (F.col(ts) >= F.lit(start))
            inside = inside if end is None else inside & (F.col(ts) < F.lit(end))
            name, ord_ = name.when(inside, label), ord_.when(inside, i)
        return df.withColumns({"ord": ord_, "season": name.otherwise(outside)})
    own, cuts = df.select(F.struct(*df.columns).alias("_row"), F.col(ts).alias("_ts")), segments(periods)
    nothing = F.lit(None).cast(cuts.schema["_segment"].dataType)
    # A null time is no segment's; segments come before the rows that start with them.
    both = own.select("_row", "_ts", F.lit(1).alias("_kind"), nothing.alias("_segment"))
    both = both.unionByName(cuts.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col("_ts").cast(own.schema["_ts"].dataType), F.lit(0).alias("_kind"), "_segment"))
    # Rows without a time come before the segment that is open on the left, whose _ts is null too.
    untimed = F.when((F.col("_kind") == 1) & F.col("_ts").isNull(), 0).otherwise(1)
    found = last_known(both.withColumn("_timed", untimed), [F.asc("_timed"), F.asc_nulls_first("_ts"), F.asc("_kind")], "_segment").filter("_kind = 1")
    return found.select("_row.*", F.col("_segment.ord").alias("ord"), F.coalesce("_segment.season", F.lit(outside)).alias("season"))


def segments(periods: DataFrame) -> DataFrame:
    """_ts, _segment: where another interval begins to be the first that holds a time, and its (ord, season), both null where none does; the first _ts is null, before all.

    All starts and ends, in order, are the leaves of a binary tree. An interval
    covers at most two nodes of each level, a segment lies in one, and the first
    interval of a node is a minimum; so everything is an equality of nodes.
    """
    periods = periods.filter("start_ts is null or end_ts is null or start_ts < end_ts")
    ends = periods.select(F.col("start_ts").alias("_ts")).union(periods.select("end_ts"))
    leaves = placed(ends.union(ends.sparkSession.range(1).select(F.lit(None).cast(ends.schema["_ts"].dataType))).distinct(), [F.asc_nulls_first("_ts")], "_leaf")
    n = leaves.count()
    levels = max(n.bit_length(), 1)
    start, end = leaves.select(F.col("_ts").alias("start_ts"), F.col("_leaf").alias("_low")), leaves.select(F.col("_ts").alias("end_ts"), F.col("_leaf").alias("_high"))
    spans = periods.join(start, periods.start_ts.eqNullSafe(start.start_ts)).drop(start.start_ts)
    spans = spans.join(end, "end_ts", "left").select(F.struct("ord", "season").alias("_first"), "_low", F.coalesce("_high", F.lit(n + 1)).alias("_high"))
    each = spans.select("_first", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"), "_low", "_high")
    low, high = F.expr("shiftright(_low + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_high, _level)")
    each = each.select("_first", "_level", low.alias("_low"), high.alias("_high")).filter("_low < _high")
    odd = lambda c: c % 2 == 1
    covered = F.array_compact(F.array(F.when(odd(F.col("_low")), F.col("_low")), F.when(odd(F.col("_high")), F.col("_high") - 1)))
    nodes = each.select("_first", "_level", F.explode(covered).alias("_node")).groupBy("_level", "_node").agg(F.min("_first").alias("_first"))
    paths = leaves.select("_ts", "_leaf", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")).withColumn("_node", F.expr("shiftright(_leaf, _level)"))
    top = F.col("_level") >= max(levels - TOP, 0)
    found = paths.filter(top).join(F.broadcast(nodes.filter(top)), ["_level", "_node"]).unionByName(paths.filter(~top).join(nodes.filter(~top), ["_level", "_node"]))
    best = found.groupBy("_leaf").agg(F.min("_first").alias("_first"))
    none = F.struct(F.lit(None).cast(periods.schema["ord"].dataType).alias("ord"), F.lit(None).cast("string").alias("season"))
    return leaves.join(best, "_leaf", "left").select("_ts", F.coalesce("_first", none).alias("_segment"))


def health(df: DataFrame, *keys: str) -> DataFrame:
    """total, positive, negative and approval in percent of each group."""
    sides = df.groupBy(*keys).agg(F.count("*").alias("total"), count_if(F.col("sentiment") == "positive").alias("positive"), count_if(F.col("sentiment") == "negative").alias("negative"))
    return sides.withColumn("approval", percent(F.col("positive"), F.col("total")))


def last_two(per_period: DataFrame) -> DataFrame:
    """The last two rows of a table with one row for each period (ord and more), with is_last."""
    place = F.row_number().over(Window.orderBy(F.desc("ord")))  # periods, not records
    return per_period.filter("ord is not null").withColumn("_place", place).filter("_place <= 2").withColumn("is_last", F.col("_place") == 1).drop("_place")


def share_changes(counts: DataFrame, per_period: DataFrame, n: int = 15) -> DataFrame:
    """Keys whose share rose (trending) or fell (fixed) most between the last two periods.

    counts: ord, tag, n; per_period: ord, total, a row for each period that
    occurs. Shares are percent of the period's total (at least 1); the difference
    is rounded, and ranked as rounded.
    """
    two = last_two(per_period)
    side = lambda last, x: F.coalesce(F.sum(F.when(F.col("is_last") == last, x)), F.lit(0)).cast("long")
    t = two.agg(side(False, F.col("total")).alias("t0"), side(True, F.col("total")).alias("t1"), F.count("*").alias("periods"))
    c = counts.join(F.broadcast(two.select("ord", "is_last")), "ord").groupBy("tag").agg(side(False, F.col("n")).alias("prev"), side(True, F.col("n")).alias("curr"))  # two rows
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)) * 100
    both = c.crossJoin(F.broadcast(t)).filter("periods = 2")  # t is one row
    both = both.select("tag", "prev", "curr", F.round(share("curr", "t1") - share("prev", "t0"), 1).alias("delta"))
    both = both.withColumn("kind", F.when(F.col("delta") > 0, "trending").when(F.col("delta") < 0, "fixed")).filter("kind is not null")
    return top_per_group(both, ["kind"], [F.desc(F.abs("delta")), F.asc("tag")], n).drop("rank")


def with_previous(counts: DataFrame, ords: DataFrame) -> DataFrame:
    """counts (ord, text, n) against the previous present period: (ord, text, prev, curr) of every text in either, from the second period on."""
    pairs = ords.withColumn("before", F.lag("ord").over(Window.orderBy("ord"))).filter("before is not null")  # a row for each period
    now = counts.join(F.broadcast(pairs.select("ord")), "ord").select("ord", "text", F.lit(0).cast("long").alias("prev"), F.col("n").alias("curr"))
    then = counts.withColumnRenamed("ord", "before").join(F.broadcast(pairs), "before").select("ord", "text", F.col("n").alias("prev"), F.lit(0).cast("long").alias("curr"))
    return now.unionByName(then).groupBy("ord", "text").agg(F.sum("prev").alias("prev"), F.sum("curr").alias("curr"))


def classified_changes(pairs: DataFrame, least: int = 5, change: int = 50, caps: tuple[int, int, int, int] = (15, 15, 10, 10)) -> DataFrame:
    """new, gone, up and down texts of each period, at most caps of each."""
    prev, curr = F.col("prev"), F.col("curr")
    pct = change_percent(curr, prev)
    both = (prev >= least) & (curr >= least)
    kind = F.when((prev == 0) & (curr >= least), "new").when((curr == 0) & (prev >= least), "gone").when(both & (pct >= change), "up").when(both & (pct <= -change), "down")
    rows = pairs.withColumns({"pct": F.when(both, pct), "kind": kind}).filter("kind is not null")
    size: Column = F.when(F.col("kind") == "new", curr).when(F.col("kind") == "gone", prev).when(F.col("kind") == "up", F.col("pct")).otherwise(-F.col("pct"))
    w = Window.partitionBy("ord", "kind").orderBy(F.desc("_size"), F.asc("text"))
    limit = F.when(F.col("kind") == "new", caps[0]).when(F.col("kind") == "gone", caps[1]).when(F.col("kind") == "up", caps[2]).otherwise(caps[3])
    return rows.withColumn("_size", size).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_size")


def lagged(df: DataFrame, value: str, order: str = "ord", groups: Sequence[str] = (), name: str = "previous") -> DataFrame:
    """value of the previous present period of the group."""
    w = Window.partitionBy(*groups).orderBy(order) if groups else Window.orderBy(order)
    return df.withColumn(name, F.lag(value).over(w))
