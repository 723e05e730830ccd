"""Named queries over the tables, each with the SQL that must give the same rows.

Ties go to the smaller key; percents are rounded half up from doubles; counts
are longs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_engine.functions import numbers, rule_tables, text as textfn, time
from feedback_engine.functions import canonical_tables
from feedback_engine.functions.canonical import canonicalised
from feedback_engine.operators import issues as issue_ops
from feedback_engine.operators import agreement, explore, periods, quality, rank, sampling, scan, shape, tags, textmining
from feedback_engine.plans import views
from feedback_engine.plans.views import sql, table
from feedback_engine.session import shared_folder
from feedback_engine.sources import pages, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(statement: str | None) -> Callable:
    """Register a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if statement is not None:
            ORACLE_SQL[f.__name__] = sql(statement)
        return f

    return register


PCT = "coalesce(round(CASE WHEN {1} = 0 THEN NULL ELSE CAST({0} AS DOUBLE) / {1} * 100 END, 1), 0)"
SIDES = "CAST(count(*) AS BIGINT) AS total, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative"
HEALTH = SIDES + ", " + PCT.format("count(*) FILTER (sentiment = 'positive')", "count(*)") + " AS approval"


def top_sql(inner: str, groups: str, order: str, n: int, columns: str) -> str:
    over = f"PARTITION BY {groups} " if groups else ""
    return f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER ({over}ORDER BY {order}) AS INTEGER) AS rank FROM ({inner})) WHERE rank <= {n}"


# --- seasons and profiles ---


@query(f"SELECT season, {HEALTH} FROM rec GROUP BY season")
def season_health(spark, d):
    return periods.health(views.records(spark, d), "season")


@query("SELECT rec_id, ord, season FROM rec")
def season_interval_join(spark, d):
    return views.records(spark, d).select("rec_id", "ord", "season")


@query("SELECT rec_id, hours, bracket FROM rec")
def playtime_bracket(spark, d):
    return views.records(spark, d).select("rec_id", "hours", "bracket")


@query(f"""SELECT {SIDES}, CAST(sum(CASE WHEN tagged THEN 1 ELSE 0 END) AS BIGINT) AS classified, CAST(sum(CASE WHEN tagged THEN 0 ELSE 1 END) AS BIGINT) AS unclassified, count(DISTINCT language) AS n_languages,
 count(*) FILTER (u > ts + INTERVAL 60 DAY) AS updated
 FROM (SELECT rec.*, rec_id IN (SELECT rec_id FROM tag) AS tagged, u FROM rec LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS u FROM lineitem GROUP BY 1) ON l_orderkey = rec_id)""")
def overview_stats(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    per_record = lines.groupBy(F.col("l_orderkey").alias("rec_id")).agg(F.max("l_shipdate").alias("u"), F.max(F.col("p_partkey").isNotNull()).alias("tagged"))
    rows = views.records(spark, d).join(per_record, "rec_id", "left").withColumn("tagged", F.coalesce("tagged", F.lit(False)))
    own = F.col("sentiment")
    return rows.agg(
        F.count("*").alias("total"), numbers.count_if(own == "positive").alias("positive"), numbers.count_if(own == "negative").alias("negative"),
        numbers.count_if(F.col("tagged")).alias("classified"), numbers.count_if(~F.col("tagged")).alias("unclassified"), F.count_distinct("language").alias("n_languages"),
        numbers.count_if(F.coalesce(F.col("u") > F.col("ts") + F.expr("INTERVAL '60' DAY"), F.lit(False))).alias("updated"),
    )


RANKINGS = """WITH s AS (SELECT sentiment, count(*) AS total, count(*) FILTER (rec_id NOT IN (SELECT rec_id FROM tag)) AS unclassified FROM rec {where} GROUP BY 1), n AS (SELECT sentiment, tag, count(*) AS n FROM rt {where} GROUP BY 1, 2)
 SELECT n.sentiment, tag, n, total, unclassified FROM n JOIN s ON s.sentiment = n.sentiment"""


def _rankings(spark, d, where: str):
    """Tags of each side with the side's records and those of them without a tag."""
    sets = views.tagged(spark, d).groupBy("rec_id").agg(F.collect_list("tag").alias("tags"))
    rows = views.records(spark, d).filter(where).select("rec_id", "sentiment").join(sets, "rec_id", "left")
    # A record counts once for itself (a null tag) and once for each tag.
    each = rows.select("sentiment", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("tags", F.array().cast("array<string>")))).alias("tag"), F.col("tags").isNull().alias("bare"))
    found = each.groupBy("sentiment", "tag").agg(F.count("*").alias("n"), numbers.count_if(F.col("bare")).alias("bare"))
    sides = found.filter("tag is null").select("sentiment", F.col("n").alias("total"), F.col("bare").alias("unclassified"))
    return found.filter("tag is not null").select("sentiment", "tag", "n").join(F.broadcast(sides), "sentiment").select("sentiment", "tag", "n", "total", "unclassified")  # two rows


@query(RANKINGS.format(where=""))
def category_rankings(spark, d):
    return _rankings(spark, d, "true")


@query(top_sql("SELECT season, sentiment, tag, count(*) AS n FROM rt GROUP BY season, sentiment, tag", "season, sentiment", "n DESC, tag", 10, "season, sentiment, tag, n, rank"))
def season_top_tags(spark, d):
    return rank.top_counts(views.record_tags(spark, d), ["season", "sentiment"], "tag", 10)


@query("SELECT tag, season, bracket, sentiment, count(*) AS n FROM rt GROUP BY tag, season, bracket, sentiment")
def cat_season_bracket(spark, d):
    return rank.counted(views.record_tags(spark, d), "tag", "season", "bracket", "sentiment")


@query(f"SELECT strftime(ts, '%Y-%m') AS month, {SIDES} FROM rec GROUP BY 1")
def monthly_timeline(spark, d):
    return periods.health(views.records(spark, d).withColumn("month", time.month(F.col("ts"))), "month").drop("approval")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {SIDES}, arg_min(season, (ts, rec_id)) AS season FROM rec GROUP BY 1")
def daily_timeline(spark, d):
    rows = views.records(spark, d).withColumn("day", time.day(F.col("ts")))
    own = F.col("sentiment")
    return rows.groupBy("day").agg(F.count("*").alias("total"), numbers.count_if(own == "positive").alias("positive"), numbers.count_if(own == "negative").alias("negative"), F.min_by("season", F.struct("ts", "rec_id")).alias("season"))


@query("WITH busy AS (SELECT strftime(ts, '%Y-%m-%d') AS day FROM rec GROUP BY 1 HAVING count(*) >= 10),\nn AS (SELECT strftime(ts, '%Y-%m-%d') AS day, tag, count(*) AS n FROM rt WHERE sentiment = 'negative' GROUP BY 1, 2) " + top_sql("SELECT n.* FROM n SEMI JOIN busy USING (day)", "day", "n DESC, tag", 5, "day, tag, n, rank"))
def daily_top_tags(spark, d):
    day = time.day(F.col("ts"))
    busy = rank.counted(views.records(spark, d).withColumn("day", day), "day").filter("n >= 10").select("day")
    rows = views.record_tags(spark, d).filter("sentiment = 'negative'").withColumn("day", day)
    return rank.top_per_group(rank.counted(rows, "day", "tag").join(busy, "day", "left_semi"), ["day"], [F.desc("n"), F.asc("tag")], 5)


BRACKET_ROWS = ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(numbers.BRACKETS))


@query(f"WITH b(place, bracket) AS (VALUES {BRACKET_ROWS}) SELECT place, b.bracket, count(rec_id) AS total, count(rec_id) FILTER (sentiment = 'positive') AS positive, count(rec_id) FILTER (sentiment = 'negative') AS negative, " + PCT.format("count(rec_id) FILTER (sentiment = 'positive')", "count(rec_id)") + " AS approval FROM b LEFT JOIN rec ON rec.bracket = b.bracket GROUP BY 1, 2")
def bracket_profile(spark, d):
    names = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(numbers.BRACKETS)], "place int, bracket string")
    found = periods.health(views.records(spark, d), "bracket")
    return names.join(found, "bracket", "left").select("place", "bracket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "positive", "negative")], F.coalesce("approval", F.lit(0.0)).alias("approval"))


@query(top_sql("SELECT bracket, sentiment, tag, count(*) AS n FROM rt GROUP BY 1, 2, 3", "bracket, sentiment", "n DESC, tag", 10, "bracket, sentiment, tag, n, rank"))
def bracket_top_tags(spark, d):
    return rank.top_counts(views.record_tags(spark, d), ["bracket", "sentiment"], "tag", 10)


@query("SELECT sentiment, tag, bracket, count(*) AS n FROM rt GROUP BY sentiment, tag, bracket")
def tag_bracket_heatmap(spark, d):
    return rank.counted(views.record_tags(spark, d), "sentiment", "tag", "bracket")


@query(f"SELECT season, bracket, {HEALTH} FROM rec GROUP BY season, bracket HAVING count(*) >= 5")
def cohort_matrix(spark, d):
    return periods.health(views.records(spark, d), "season", "bracket").filter("total >= 5")


@query("WITH big AS (SELECT season, bracket FROM rec GROUP BY 1, 2 HAVING count(*) >= 5),\nn AS (SELECT season, bracket, tag, count(*) AS n FROM rt WHERE sentiment = 'negative' GROUP BY 1, 2, 3) " + top_sql("SELECT n.* FROM n SEMI JOIN big USING (season, bracket)", "season, bracket", "n DESC, tag", 5, "season, bracket, tag, n, rank"))
def cohort_top_tags(spark, d):
    big = rank.counted(views.records(spark, d), "season", "bracket", name="m").filter("m >= 5").select("season", "bracket")
    rows = rank.counted(views.record_tags(spark, d).filter("sentiment = 'negative'"), "season", "bracket", "tag")
    return rank.top_per_group(rows.join(F.broadcast(big), ["season", "bracket"], "left_semi"), ["season", "bracket"], [F.desc("n"), F.asc("tag")], 5)  # seasons x brackets


@query(f"SELECT language, {HEALTH} FROM rec GROUP BY language HAVING count(*) >= 20")
def regional_health(spark, d):
    return periods.health(views.records(spark, d), "language").filter("total >= 20")


@query("WITH big AS (SELECT language FROM rec GROUP BY language HAVING count(*) >= 20),\nn AS (SELECT language, sentiment, tag, count(*) AS n FROM rt GROUP BY language, sentiment, tag) " + top_sql("SELECT n.* FROM n SEMI JOIN big USING (language)", "language, sentiment", "n DESC, tag", 5, "language, sentiment, tag, n, rank"))
def regional_profile(spark, d):
    big = rank.counted(views.records(spark, d), "language", name="m").filter("m >= 20").select("language")
    rows = rank.counted(views.record_tags(spark, d), "language", "sentiment", "tag").join(F.broadcast(big), "language", "left_semi")  # languages
    return rank.top_per_group(rows, ["language", "sentiment"], [F.desc("n"), F.asc("tag")], 5)


@query("SELECT language || '/' || tag AS tag, count(DISTINCT season) AS periods FROM rt WHERE sentiment = 'negative' GROUP BY 1 HAVING count(DISTINCT season) >= 9")
def recurring_tags(spark, d):
    rows = views.record_tags(spark, d).filter("sentiment = 'negative'").select(F.concat_ws("/", "language", "tag").alias("tag"), "season")
    return tags.recurring(rows, "season", 9)


@query("""WITH h AS (SELECT season, count(*) AS total, count(*) FILTER (sentiment = 'positive') AS positive FROM rec WHERE hc GROUP BY season), a AS (SELECT count(*) FILTER (hc) AS n, count(*) AS m FROM rec)
 SELECT b.season, coalesce(h.total, 0) AS total, coalesce(h.positive, 0) AS positive, coalesce(h.total, 0) - coalesce(h.positive, 0) AS negative FROM (SELECT DISTINCT season FROM rec) b LEFT JOIN h ON h.season = b.season, a WHERE a.n > 0 AND a.n < a.m""")
def hc_overlay(spark, d):
    rows = views.records(spark, d)
    n = rows.agg(numbers.count_if(F.col("hc")).alias("n"), F.count("*").alias("m")).filter("n > 0 and n < m").select(F.lit(1).alias("one"))
    high = periods.health(rows.filter("hc"), "season").drop("approval")
    out = rows.select("season").distinct().join(high, "season", "left").select("season", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "positive", "negative")])
    return out.crossJoin(F.broadcast(n)).drop("one")  # n is one row or none


#: The overlay exists only where some records, but not all, are of high confidence.
PART_HIGH = "(SELECT count(*) FILTER (hc) FROM rec) > 0 AND (SELECT count(*) FILTER (NOT hc) FROM rec) > 0"


def _if_part(spark, d, df):
    both = views.records(spark, d).agg(F.min("hc").alias("a"), F.max("hc").alias("b")).filter("not a and b").select(F.lit(1).alias("_one"))
    return df.crossJoin(F.broadcast(both)).drop("_one")  # one row or none


@query(f"SELECT * FROM (SELECT {SIDES} FROM rec WHERE hc) WHERE {PART_HIGH}")
def hc_overview(spark, d):
    rows = views.records(spark, d).filter("hc").withColumn("all", F.lit(1))
    return _if_part(spark, d, periods.health(rows, "all").drop("all", "approval"))


@query(f"SELECT * FROM ({RANKINGS.format(where='WHERE hc')}) WHERE {PART_HIGH}")
def hc_category_rankings(spark, d):
    return _if_part(spark, d, _rankings(spark, d, "hc"))


@query(f"SELECT * FROM ({top_sql('SELECT season, sentiment, tag, count(*) AS n FROM rt WHERE hc GROUP BY 1, 2, 3', 'season, sentiment', 'n DESC, tag', 10, 'season, sentiment, tag, n, rank')}) WHERE {PART_HIGH}")
def hc_season_top_tags(spark, d):
    return _if_part(spark, d, rank.top_counts(views.record_tags(spark, d).filter("hc"), ["season", "sentiment"], "tag", 10))


@query(f"SELECT * FROM (SELECT strftime(ts, '%Y-%m') AS month, {SIDES} FROM rec WHERE hc GROUP BY 1) WHERE {PART_HIGH}")
def hc_monthly_timeline(spark, d):
    rows = views.records(spark, d).filter("hc").withColumn("month", time.month(F.col("ts")))
    return _if_part(spark, d, periods.health(rows, "month").drop("approval"))


@query("""SELECT count(*) AS total, count(*) FILTER (k > 0) AS tagged, count(*) FILTER (k = 0) AS untagged, count(*) FILTER (k > 1) AS multi, round(CAST(sum(k) AS DOUBLE) / count(*) FILTER (k > 0), 2) AS per_tagged
 FROM (SELECT rec.rec_id, count(tag.tag) AS k FROM rec LEFT JOIN tag ON tag.rec_id = rec.rec_id GROUP BY rec.rec_id)""")
def multi_tag_stats(spark, d):
    sets = views.tagged(spark, d).groupBy("rec_id").agg(F.collect_set("tag").alias("tags"))
    rows = views.records(spark, d).select("rec_id").join(sets, "rec_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return tags.multi_tag_stats(rows)


@query("""SELECT count(*) AS total, count(*) FILTER (u > o_orderdate + INTERVAL 60 DAY) AS updated, coalesce(round(CAST(count(*) FILTER (u > o_orderdate + INTERVAL 60 DAY) AS DOUBLE) / count(*) * 100, 1), 0) AS pct
 FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS u FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def updated_share(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("u"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    late = F.coalesce(F.col("u") > F.col("o_orderdate") + F.expr("INTERVAL '60' DAY"), F.lit(False))
    out = rows.agg(F.count("*").alias("total"), numbers.count_if(late).alias("updated"))
    return out.withColumn("pct", numbers.percent(F.col("updated"), F.col("total")))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE CAST(c_nationkey AS DOUBLE) END AS value FROM customer")
def value_fallback(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.first_positive(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("value"))


# --- periods, shares, pairs ---


@query("""WITH two AS (SELECT ord, row_number() OVER (ORDER BY ord DESC) AS k FROM (SELECT DISTINCT ord FROM rec WHERE ord IS NOT NULL) ORDER BY ord DESC LIMIT 2),
 t AS (SELECT coalesce(sum(CASE WHEN k = 2 AND sentiment = 'negative' THEN 1 ELSE 0 END), 0) AS t0, coalesce(sum(CASE WHEN k = 1 AND sentiment = 'negative' THEN 1 ELSE 0 END), 0) AS t1 FROM rec JOIN two USING (ord)),
 c AS (SELECT tag, count(*) FILTER (k = 2) AS prev, count(*) FILTER (k = 1) AS curr FROM rt JOIN two USING (ord) WHERE sentiment = 'negative' GROUP BY tag),
 s AS (SELECT tag, prev, curr, round(CAST(curr AS DOUBLE) / greatest(t1, 1) * 100 - CAST(prev AS DOUBLE) / greatest(t0, 1) * 100, 1) AS delta FROM c, t WHERE (SELECT count(*) FROM two) = 2)
 SELECT tag, prev, curr, delta, 'trending' AS kind FROM (SELECT * FROM s WHERE delta > 0 ORDER BY delta DESC, tag LIMIT 15)
 UNION ALL SELECT tag, prev, curr, delta, 'fixed' AS kind FROM (SELECT * FROM s WHERE delta < 0 ORDER BY delta, tag LIMIT 15)""")
def trending_fixed(spark, d):
    per_period = views.records(spark, d).filter("ord is not null").groupBy("ord").agg(numbers.count_if(F.col("sentiment") == "negative").alias("total"))
    counts = rank.counted(views.record_tags(spark, d).filter("sentiment = 'negative' and ord is not null"), "ord", "tag")
    return periods.share_changes(counts, per_period)


@query("WITH n AS (SELECT topic AS tag, text, count(*) AS n FROM ri WHERE kind = 'complaint' AND ord = (SELECT max(ord) FROM rec) GROUP BY 1, 2) " + top_sql("SELECT * FROM n", "tag", "n DESC, text", 3, "tag, text, n, rank"))
def trend_top_issues(spark, d):
    last = periods.last_two(views.records(spark, d).select("ord").distinct()).filter("is_last").select("ord")
    rows = views.record_issues(spark, d).filter("kind = 'complaint'").join(F.broadcast(last), "ord").withColumnRenamed("topic", "tag")  # one row
    return rank.top_counts(rows, ["tag"], "text", 3)


CHANGES = """WITH c AS (SELECT ord, text, count(*) AS n FROM ri WHERE kind = 'complaint' AND ord IS NOT NULL GROUP BY 1, 2),
 o AS (SELECT ord, lag(ord) OVER (ORDER BY ord) AS before FROM (SELECT DISTINCT ord FROM c)),
 p AS (SELECT ord, text, CAST(sum(prev) AS BIGINT) AS prev, CAST(sum(curr) AS BIGINT) AS curr FROM (
   SELECT c.ord, text, 0 AS prev, n AS curr FROM c JOIN o ON o.ord = c.ord AND before IS NOT NULL UNION ALL SELECT o.ord, text, n, 0 FROM c JOIN o ON o.before = c.ord) GROUP BY 1, 2),
 k AS (SELECT *, CASE WHEN prev >= 5 AND curr >= 5 THEN CAST(round(CAST(curr - prev AS DOUBLE) / prev * 100, 0) AS BIGINT) END AS pct FROM p),
 f AS (SELECT *, CASE WHEN prev = 0 AND curr >= 5 THEN 'new' WHEN curr = 0 AND prev >= 5 THEN 'gone' WHEN pct >= 50 THEN 'up' WHEN pct <= -50 THEN 'down' END AS kind FROM k),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord, kind ORDER BY CASE kind WHEN 'new' THEN curr WHEN 'gone' THEN prev WHEN 'up' THEN pct ELSE -pct END DESC, text) AS INTEGER) AS rank FROM f WHERE kind IS NOT NULL)
 SELECT ord, text, prev, curr, pct, kind, rank FROM r WHERE rank <= CASE kind WHEN 'new' THEN 15 WHEN 'gone' THEN 15 ELSE 10 END"""


@query(CHANGES)
def season_diffs(spark, d):
    counts = rank.counted(views.record_issues(spark, d).filter("kind = 'complaint' and ord is not null"), "ord", "text")
    return periods.classified_changes(periods.with_previous(counts, counts.select("ord").distinct()))


@query("SELECT ord, n, lag(n) OVER (ORDER BY ord) AS previous FROM (SELECT ord, count(*) AS n FROM rec WHERE ord IS NOT NULL GROUP BY ord)")
def season_lag(spark, d):
    return periods.lagged(rank.counted(views.records(spark, d).filter("ord is not null"), "ord"), "n")


@query("""WITH g AS (SELECT language, count(*) AS total FROM rec WHERE sentiment = 'negative' GROUP BY 1 HAVING count(*) >= 50), c AS (SELECT tag, count(*) AS tag_n FROM rt WHERE sentiment = 'negative' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
 a AS (SELECT count(*) AS n FROM rec WHERE sentiment = 'negative'), o AS (SELECT language, tag, count(*) AS own_n FROM rt WHERE sentiment = 'negative' GROUP BY 1, 2),
 s AS (SELECT g.language, c.tag, coalesce(CAST(own_n AS DOUBLE) / total * 100, 0) AS share, CAST(tag_n AS DOUBLE) / greatest(a.n, 1) * 100 AS base FROM g CROSS JOIN c CROSS JOIN a LEFT JOIN o ON o.language = g.language AND o.tag = c.tag)
 SELECT language, tag, round(share, 1) AS share, round(base, 1) AS base, round(share - base, 1) AS diff FROM s WHERE abs(share - base) >= 3""")
def regional_deviation(spark, d):
    negative = "sentiment = 'negative'"
    return tags.deviation(views.records(spark, d).filter(negative), views.record_tags(spark, d).filter(negative))


@query("""WITH p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n FROM tag x JOIN tag y ON x.rec_id = y.rec_id AND x.tag < y.tag GROUP BY 1, 2 HAVING count(*) >= 500), t AS (SELECT tag, count(*) AS m FROM tag GROUP BY 1)
 SELECT tag_a, tag_b, n, round(CAST(n AS DOUBLE) / a.m * 100, 1) AS pct_a, round(CAST(n AS DOUBLE) / b.m * 100, 1) AS pct_b FROM p JOIN t a ON a.tag = tag_a JOIN t b ON b.tag = tag_b""")
def tag_cooccurrence(spark, d):
    return tags.cooccurrence(views.tagged(spark, d), "rec_id", "tag")


TOPICS = [("Shine", "STANDARD", "ECONOMY"), ("Size", "SMALL", "LARGE"), ("Kind", "PROMO", "MEDIUM"), ("Price", "ECONOMY", "PROMO"), ("Bulk", "LARGE", "SMALL"), ("Middle", "MEDIUM", "STANDARD")]


@query("""WITH s AS (SELECT season, count(*) FILTER (sentiment = 'negative') AS neg, count(*) FILTER (sentiment = 'positive') AS pos FROM rec GROUP BY 1),
 p(topic, neg_tag, pos_tag) AS (VALUES """ + ", ".join(map(str, TOPICS)) + """),
 c AS (SELECT season, topic, count(*) FILTER (sentiment = 'negative' AND tag = neg_tag) AS neg_count, count(*) FILTER (sentiment = 'positive' AND tag = pos_tag) AS pos_count FROM rt JOIN p ON tag IN (neg_tag, pos_tag) GROUP BY 1, 2)
 SELECT s.season, p.topic, coalesce(neg_count, 0) AS neg_count, coalesce(pos_count, 0) AS pos_count, """ + PCT.format("coalesce(neg_count, 0)", "neg") + " AS neg_pct, " + PCT.format("coalesce(pos_count, 0)", "pos") + " AS pos_pct FROM s CROSS JOIN p LEFT JOIN c ON c.season = s.season AND c.topic = p.topic")
def topic_comparison(spark, d):
    pairs = F.broadcast(spark.createDataFrame(TOPICS, "topic string, neg_tag string, pos_tag string"))  # a few rows
    sides = periods.health(views.records(spark, d), "season")
    hit = views.record_tags(spark, d).join(pairs, F.col("tag").isin(F.col("neg_tag"), F.col("pos_tag")))
    own = lambda side, tag: numbers.count_if((F.col("sentiment") == side) & (F.col("tag") == F.col(tag)))
    counts = hit.groupBy("season", "topic").agg(own("negative", "neg_tag").alias("neg_count"), own("positive", "pos_tag").alias("pos_count"))
    grid = sides.crossJoin(pairs).join(counts, ["season", "topic"], "left")  # a few rows for each season
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return grid.select("season", "topic", zero("neg_count").alias("neg_count"), zero("pos_count").alias("pos_count"), numbers.percent(zero("neg_count"), F.col("negative")).alias("neg_pct"), numbers.percent(zero("pos_count"), F.col("positive")).alias("pos_pct"))


TOPIC_VALUES = "p(topic, neg_tag, pos_tag) AS (VALUES " + ", ".join(map(str, TOPICS)) + ")"


@query(f"""WITH {TOPIC_VALUES}, s AS (SELECT count(*) FILTER (sentiment = 'negative') AS neg, count(*) FILTER (sentiment = 'positive') AS pos FROM rec),
 c AS (SELECT topic, neg_tag, pos_tag, count(*) FILTER (sentiment = 'negative' AND tag = neg_tag) AS neg_count, count(*) FILTER (sentiment = 'positive' AND tag = pos_tag) AS pos_count FROM p LEFT JOIN rt ON tag IN (neg_tag, pos_tag) GROUP BY 1, 2, 3)
 SELECT topic, neg_tag, pos_tag, neg_count, pos_count, """ + PCT.format("neg_count", "neg") + " AS neg_pct, " + PCT.format("pos_count", "pos") + " AS pos_pct FROM c, s")
def topic_totals(spark, d):
    pairs = spark.createDataFrame(TOPICS, "topic string, neg_tag string, pos_tag string")
    sides = views.records(spark, d).agg(numbers.count_if(F.col("sentiment") == "negative").alias("neg"), numbers.count_if(F.col("sentiment") == "positive").alias("pos"))
    own = views.record_tags(spark, d).groupBy("tag").agg(*[numbers.count_if(F.col("sentiment") == x).alias(x) for x in ("negative", "positive")])
    found = pairs.join(own.select(F.col("tag").alias("neg_tag"), F.col("negative").alias("neg_count")), "neg_tag", "left").join(own.select(F.col("tag").alias("pos_tag"), F.col("positive").alias("pos_count")), "pos_tag", "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("neg_count", "pos_count")}).crossJoin(F.broadcast(sides))  # one row
    return found.select("topic", "neg_tag", "pos_tag", "neg_count", "pos_count", numbers.percent(F.col("neg_count"), F.col("neg")).alias("neg_pct"), numbers.percent(F.col("pos_count"), F.col("pos")).alias("pos_pct"))


@query(f"""WITH {TOPIC_VALUES}, w AS (SELECT topic, 'negative' AS sentiment, neg_tag AS tag FROM p UNION ALL SELECT topic, 'positive', pos_tag FROM p), x AS (SELECT rec_id, arg_min(text, (line, text)) AS text FROM iss GROUP BY 1),
 r AS (SELECT w.topic, w.sentiment, rt.rec_id, substr(x.text, 1, 600) AS text, votes_up, hours, season, language FROM w JOIN rt ON rt.tag = w.tag AND rt.sentiment = w.sentiment JOIN x ON x.rec_id = rt.rec_id
  WHERE length(x.text) >= 20 AND length(regexp_replace(x.text, '[^\\p{{L}}]', '', 'g')) / CAST(length(x.text) AS DOUBLE) > 0.35) """ + top_sql("SELECT * FROM r", "topic, sentiment", "votes_up DESC, rec_id", 3, "topic, sentiment, rec_id, text, votes_up, hours, season, language, rank"))
def topic_examples(spark, d):
    wanted = [(t, side, tag) for t, neg, pos in TOPICS for side, tag in (("negative", neg), ("positive", pos))]
    wanted = F.broadcast(spark.createDataFrame(wanted, "topic string, sentiment string, tag string"))
    found = views.record_tags(spark, d).select("rec_id", "sentiment", "tag", "votes_up", "hours", "season", "language").join(wanted, ["sentiment", "tag"])
    texts = views.issues(spark, d).groupBy("rec_id").agg(F.min_by("text", F.struct("line", "text")).alias("text")).filter(textfn.readable(F.col("text")))
    best = rank.top_per_group(found.join(texts, "rec_id"), ["topic", "sentiment"], [F.desc("votes_up"), F.asc("rec_id")], 3)
    return best.select("topic", "sentiment", "rec_id", F.substring("text", 1, 600).alias("text"), "votes_up", "hours", "season", "language", "rank")


@query("SELECT sentiment, strftime(ts, '%Y-%m') AS month, bracket, tag, count(*) AS n FROM rt GROUP BY ROLLUP (sentiment, month, bracket, tag)")
def tag_rollup(spark, d):
    return views.record_tags(spark, d).withColumn("month", time.month(F.col("ts"))).rollup("sentiment", "month", "bracket", "tag").agg(F.count("*").alias("n"))


def _share_sql(key: str) -> str:
    return f"WITH n AS (SELECT {key}, tag, count(*) AS n FROM rt GROUP BY 1, 2), s AS (SELECT *, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {key.split(' AS ')[-1]}) * 100, 1) AS pct FROM n) " + top_sql("SELECT * FROM s", key.split(" AS ")[-1], "n DESC, tag", 10, f"{key.split(' AS ')[-1]}, tag, n, pct, rank")


@query(_share_sql("strftime(ts, '%Y-%m') AS month"))
def tags_by_month(spark, d):
    rows = rank.counted(views.record_tags(spark, d).withColumn("month", time.month(F.col("ts"))), "month", "tag")
    return rank.top_per_group(rank.with_share(rows, ["month"]), ["month"], [F.desc("n"), F.asc("tag")], 10)


@query(_share_sql("bracket"))
def tags_by_bracket(spark, d):
    rows = rank.counted(views.record_tags(spark, d), "bracket", "tag")
    return rank.top_per_group(rank.with_share(rows, ["bracket"]), ["bracket"], [F.desc("n"), F.asc("tag")], 10)


# --- issues, entities, change log ---


@query("WITH n AS (SELECT kind, text, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM iss GROUP BY 1, 2) SELECT * FROM (" + top_sql("SELECT * FROM n", "kind", "n DESC, text", 50, "kind, text, n, votes, rank") + ") WHERE rank <= CASE kind WHEN 'complaint' THEN 50 ELSE 30 END")
def top_issues(spark, d):
    return issue_ops.ranked_by_kind(views.issues(spark, d), [], {"complaint": 50, "suggestion": 30, "praise": 30})


@query("WITH n AS (SELECT season, kind, text, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM ri GROUP BY 1, 2, 3) SELECT * FROM (" + top_sql("SELECT * FROM n", "season, kind", "n DESC, text", 20, "season, kind, text, n, votes, rank") + ") WHERE rank <= CASE kind WHEN 'complaint' THEN 20 ELSE 15 END")
def issues_by_season(spark, d):
    return issue_ops.ranked_by_kind(views.record_issues(spark, d), ["season"], {"complaint": 20, "suggestion": 15, "praise": 15})


@query(top_sql("SELECT strftime(ts, '%Y-%m') AS month, text, count(*) AS n FROM ri WHERE kind = 'complaint' GROUP BY 1, 2", "month", "n DESC, text", 10, "month, text, n, rank"))
def issues_by_month(spark, d):
    rows = views.record_issues(spark, d).filter("kind = 'complaint'").withColumn("month", time.month(F.col("ts")))
    return rank.top_counts(rows, ["month"], "text", 10)


@query("""WITH c AS (SELECT rec_id, language, text FROM ri WHERE kind = 'complaint' AND language <> ''),
 n AS (SELECT language, '_all' AS tag, text, count(*) AS n FROM c GROUP BY 1, 3 UNION ALL SELECT language, tag, text, count(*) FROM c JOIN tag USING (rec_id) GROUP BY 1, 2, 3),
 b AS (SELECT *, max(CASE WHEN tag = '_all' THEN n END) OVER (PARTITION BY language) AS best, max(n) OVER (PARTITION BY language, tag) AS top, CAST(row_number() OVER (PARTITION BY language, tag ORDER BY n DESC, text) AS INTEGER) AS rank FROM n)
 SELECT language, tag, text, n, rank FROM b WHERE best >= 5 AND (tag = '_all' AND rank <= 10 OR tag <> '_all' AND top >= 3 AND rank <= 5)""")
def lang_tag_issues(spark, d):
    return issue_ops.by_language_and_tag(views.record_issues(spark, d).filter("kind = 'complaint'").select("rec_id", "language", "text"), views.tagged(spark, d))


KINDS = shape.KINDS


@query("SELECT count(*) AS n_issues, count(DISTINCT rec_id) AS n_records, count(DISTINCT text) AS distinct_texts, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}, count(DISTINCT CASE WHEN kind = '{k}' THEN text END) AS distinct_{k}" for k in KINDS) + " FROM iss")
def issue_stats(spark, d):
    return issue_ops.stats(views.issues(spark, d))


@query("""SELECT count(line) AS n_issues, count(DISTINCT rec.rec_id) AS n_records, round(CAST(count(line) AS DOUBLE) / count(DISTINCT rec.rec_id), 2) AS per_record, count(*) FILTER (line = 1) AS n_primary,
 count(DISTINCT CASE WHEN line IS NULL THEN rec.rec_id END) AS n_empty, """ + PCT.format("count(DISTINCT CASE WHEN line IS NULL THEN rec.rec_id END)", "count(DISTINCT rec.rec_id)") + " AS empty_pct FROM rec LEFT JOIN iss ON iss.rec_id = rec.rec_id")
def extraction_stats(spark, d):
    per = views.issues(spark, d).groupBy("rec_id").agg(F.count("*").alias("n"), numbers.count_if(F.col("line") == 1).alias("p"))
    return issue_ops.extraction_stats(views.records(spark, d).select("rec_id").join(per, "rec_id", "left"))


@query("SELECT entity, count(*) AS n FROM iss GROUP BY 1 ORDER BY n DESC, entity LIMIT 30")
def extraction_entities(spark, d):
    return rank.top_rows(rank.counted(views.issues(spark, d), "entity"), [F.desc("n"), F.asc("entity")], 30)


@query("SELECT 'S' || votes % 10 AS season_ref, count(*) AS n FROM iss WHERE line = 2 GROUP BY 1")
def season_references(spark, d):
    ref = F.when(F.col("line") == 2, F.concat(F.lit("S"), (F.col("votes") % 10).cast("string")))
    return rank.counted(views.issues(spark, d).select(ref.alias("season_ref")).filter("season_ref is not null"), "season_ref")


@query("SELECT entity, season, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + " FROM ri WHERE entity IN (SELECT entity FROM iss GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 80) GROUP BY 1, 2")
def entity_tracking(spark, d):
    top = rank.top_rows(rank.counted(views.issues(spark, d), "entity"), [F.desc("n"), F.asc("entity")], 80).select("entity")
    rows = views.record_issues(spark, d).join(F.broadcast(top), "entity", "left_semi")  # 80 rows
    return rows.groupBy("entity", "season").agg(*[numbers.count_if(F.col("kind") == k).alias(k) for k in KINDS])


@query("WITH n AS (SELECT entity, kind, text, count(*) AS n FROM ri GROUP BY 1, 2, 3), s AS (SELECT entity, kind, text, season, count(*) AS m FROM ri GROUP BY 1, 2, 3, 4), r AS (" + top_sql("SELECT * FROM n", "entity, kind", "n DESC, text", 10, "entity, kind, text, n, rank") + """)
 SELECT r.entity, r.kind, r.text, n, rank, string_agg(season || '=' || m, ',' ORDER BY season) AS by_season FROM r JOIN s ON s.entity = r.entity AND s.kind = r.kind AND s.text = r.text GROUP BY 1, 2, 3, 4, 5""")
def entity_top_issues(spark, d):
    per = views.record_issues(spark, d).groupBy("entity", "kind", "text", "season").agg(F.count("*").alias("m"))
    whole = per.groupBy("entity", "kind", "text").agg(F.sum("m").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "season", F.col("m").cast("string")))), ",").alias("by_season"))
    return rank.top_per_group(whole, ["entity", "kind"], [F.desc("n"), F.asc("text")], 10)


CATEGORIES = [("Metal", "STANDARD"), ("Metal", "ECONOMY"), ("Scale", "SMALL"), ("Scale", "LARGE"), ("Scale", "MEDIUM"), ("Offer", "PROMO")]
BRIDGE = "bridge(category, topic) AS (VALUES " + ", ".join(map(str, CATEGORIES)) + ")"


@query(f"WITH {BRIDGE}, n AS (SELECT category, text, count(*) AS n FROM iss JOIN bridge USING (topic) WHERE kind IN ('complaint', 'suggestion') GROUP BY 1, 2) " + top_sql("SELECT * FROM n", "category", "n DESC, text", 10, "category, text, n, rank"))
def category_issues(spark, d):
    bridge = F.broadcast(spark.createDataFrame(CATEGORIES, "category string, topic string"))
    rows = views.issues(spark, d).filter(F.col("kind").isin("complaint", "suggestion"))
    rows = rows.withColumn("topic", textfn.topic(F.col("text"))).join(bridge, "topic")
    return rank.top_counts(rows, ["category"], "text", 10)


@query(f"WITH {BRIDGE} SELECT topic, 'unmapped' AS state FROM (SELECT DISTINCT topic FROM iss EXCEPT SELECT topic FROM bridge) UNION ALL SELECT topic, 'empty' FROM (SELECT topic FROM bridge EXCEPT SELECT DISTINCT topic FROM iss)")
def mapping_coverage(spark, d):
    mapped = spark.createDataFrame(CATEGORIES, "category string, topic string").select("topic").distinct()
    seen = views.issues(spark, d).select("topic").distinct()
    return seen.subtract(mapped).withColumn("state", F.lit("unmapped")).unionByName(mapped.subtract(seen).withColumn("state", F.lit("empty")))


TOP_ENTITIES = "SELECT entity, count(*) AS total FROM iss GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80"


@query(f"""WITH e AS ({TOP_ENTITIES}), i AS (SELECT DISTINCT p_brand || ' v2' AS item FROM part UNION SELECT DISTINCT p_brand FROM part),
 m AS (SELECT item, entity, row_number() OVER (PARTITION BY item ORDER BY (item = entity) DESC, total DESC, entity) AS k FROM i JOIN e ON starts_with(item, entity) OR starts_with(entity, item))
 SELECT i.item, m.entity FROM i LEFT JOIN m ON m.item = i.item AND k = 1""")
def entity_prefix_join(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct()
    items = brands.select(F.explode(F.array(F.concat("p_brand", F.lit(" v2")), F.col("p_brand"))).alias("item")).distinct()
    top = rank.top_rows(rank.counted(views.issues(spark, d), "entity", name="total"), [F.desc("total"), F.asc("entity")], 80)
    return issue_ops.matched_entities(items, top).select("item", "entity")


@query(f"""WITH e AS ({TOP_ENTITIES}), c AS (SELECT p_partkey AS change_id, p_brand AS entity, p_size % 10 AS ord FROM part WHERE p_brand IN (SELECT entity FROM e)),
 n AS (SELECT entity, ord, count(*) AS n FROM ri WHERE kind = 'complaint' AND ord IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT c.change_id, c.entity, c.ord, CASE WHEN c.ord > 0 THEN coalesce(b.n, 0) END AS before, coalesce(a.n, 0) AS after FROM c LEFT JOIN n a ON a.entity = c.entity AND a.ord = c.ord LEFT JOIN n b ON b.entity = c.entity AND b.ord = c.ord - 1)
 SELECT change_id, entity, ord, before, after, CASE WHEN before > 0 THEN CAST(round(CAST(after - before AS DOUBLE) / before * 100, 0) AS BIGINT) END AS delta_pct FROM j""")
def patch_impact(spark, d):
    top = rank.top_rows(rank.counted(views.issues(spark, d), "entity", name="total"), [F.desc("total"), F.asc("entity")], 80)
    changes = table(spark, d, "part").select(F.col("p_partkey").alias("change_id"), F.col("p_brand").alias("item"), (F.col("p_size") % 10).alias("ord"))
    changes = issue_ops.matched_entities(changes, top).filter("entity is not null").select("change_id", "entity", "ord")
    complaints = rank.counted(views.record_issues(spark, d).filter("kind = 'complaint' and ord is not null"), "entity", "ord")
    return issue_ops.impact(changes, complaints)


_IMPACT = ORACLE_SQL["patch_impact"]
_SHOWN = "coalesce(before, 0) + after >= 1"


@query(f"WITH i AS ({_IMPACT}) SELECT * FROM i WHERE ord = (SELECT max(ord) FROM i) AND {_SHOWN}")
def impact_latest(spark, d):
    """The impact table as it opens: the last season, changes that nobody spoke of hidden."""
    return explore.revealed(explore.in_period(patch_impact(spark, d)), ["before", "after"])


@query(f"WITH i AS ({_IMPACT}) SELECT * FROM i WHERE {_SHOWN}")
def impact_all_seasons(spark, d):
    return explore.revealed(explore.in_period(patch_impact(spark, d), explore.ALL), ["before", "after"])


@query("SELECT p_type AS class, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS entities FROM part GROUP BY 1")
def entity_selector(spark, d):
    return explore.selector(table(spark, d, "part"), "p_type", "p_brand").select(F.col("p_type").alias("class"), F.array_join("options", ",").alias("entities"))


@query("""WITH c AS (SELECT p_brand AS entity, p_size % 10 AS ord, count(*) AS changes FROM part GROUP BY 1, 2), n AS (SELECT entity, ord, """ + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + """ FROM ri WHERE ord IS NOT NULL GROUP BY 1, 2)
 SELECT coalesce(c.entity, n.entity) AS entity, coalesce(c.ord, n.ord) AS ord, coalesce(changes, 0) AS changes, """ + ", ".join(f"coalesce({k}, 0) AS {k}" for k in KINDS) + " FROM c FULL JOIN n ON c.entity = n.entity AND c.ord = n.ord")
def entity_timeline(spark, d):
    changes = table(spark, d, "part").select(F.col("p_brand").alias("entity"), (F.col("p_size") % 10).cast("int").alias("ord"))
    counts = views.record_issues(spark, d).filter("ord is not null").groupBy("entity", "ord").agg(*[numbers.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    return explore.entity_timeline(changes, counts)


@query("""SELECT coalesce(n.k, o.k) AS p_partkey, coalesce(n.name, o.name) AS p_name, coalesce(n.price, o.price) AS p_retailprice FROM (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN upper(p_name) END AS name, p_retailprice AS price FROM part WHERE p_partkey % 3 <> 0) n
 FULL JOIN (SELECT p_partkey AS k, p_name AS name, p_retailprice / 2 AS price FROM part WHERE p_partkey % 2 = 0) o ON o.k = n.k""")
def patch_upsert(spark, d):
    part = table(spark, d, "part")
    base = part.filter("p_partkey % 2 = 0").select("p_partkey", "p_name", (F.col("p_retailprice") / 2).alias("p_retailprice"))
    update = part.filter("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_size") > 25, F.upper("p_name")).alias("p_name"), "p_retailprice")
    return shape.upserted(base, update, "p_partkey", ["p_name", "p_retailprice"])


@query("SELECT text, count(*) AS n, " + ", ".join(f"count(*) FILTER (bracket = '{n}') AS n_{i}" for i, (_, n) in enumerate(numbers.BRACKETS)) + " FROM ri GROUP BY text")
def issue_bracket_dist(spark, d):
    return issue_ops.distribution(views.record_issues(spark, d), "bracket", [n for _, n in numbers.BRACKETS])


@query("SELECT text, season, bracket, count(*) AS n FROM ri GROUP BY 1, 2, 3")
def issue_season_bracket_dist(spark, d):
    return rank.counted(views.record_issues(spark, d), "text", "season", "bracket")


@query("SELECT version, day, row_number() OVER (ORDER BY day NULLS LAST, version) AS place FROM (SELECT p_partkey AS version, CASE WHEN p_partkey % 7 > 0 THEN '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS day FROM part)")
def change_log_order(spark, d):
    log = table(spark, d, "part").select(F.col("p_partkey").alias("version"), F.when(F.col("p_partkey") % 7 > 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))).alias("day"))
    return issue_ops.ordered_log(log, "day", "version")


@query(f"""SELECT rec_id, place, votes, {PCT.format("place", "n")} AS rows_pct, {PCT.format("votes", "v")} AS votes_pct FROM (SELECT rec_id, row_number() OVER w AS place, CAST(sum(votes_up) OVER w AS BIGINT) AS votes, count(*) OVER () AS n, CAST(sum(votes_up) OVER () AS BIGINT) AS v FROM rec WINDOW w AS (ORDER BY ts, rec_id ROWS UNBOUNDED PRECEDING))""")
def progress_totals(spark, d):
    """How far a run over all records, by time, has come at each of them."""
    rows = views.records(spark, d).select("rec_id", "ts", "votes_up")
    return scan.with_progress(rows, [F.asc("ts"), F.asc("rec_id")], "votes_up", "votes").select("rec_id", "place", "votes", "rows_pct", "votes_pct")


@query("WITH k AS (" + top_sql("SELECT kind, text, count(*) AS n FROM iss GROUP BY 1, 2", "kind", "n DESC, text", 20, "text") + " UNION " + top_sql("SELECT entity, text, count(*) AS n FROM iss GROUP BY 1, 2", "entity", "n DESC, text", 5, "text") + ") SELECT rec_id, line, text FROM iss WHERE text IN (SELECT text FROM k)")
def needed_issue_semi(spark, d):
    rows = views.issues(spark, d)
    needed = rank.top_counts(rows, ["kind"], "text", 20).select("text").union(rank.top_counts(rows, ["entity"], "text", 5).select("text")).distinct()
    return rows.select("rec_id", "line", "text").join(needed, "text", "left_semi").select("rec_id", "line", "text")


# --- text ---

def _values(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def _lookup(name: str, table: dict[str, str]) -> str:
    return f"{name}(k, v) AS (VALUES " + ", ".join(_values(pair) for pair in table.items()) + ")"


_T = canonical_tables
_RULED = [*_T.FUN, *_T.SATISFYING, *_T.BEAUTIFUL, *_T.GOOD, *_T.COMBAT, *_T.UNEVEN_TOPICS], [*_T.PRAISE, "good", *_T.UNEVEN, *_T.ANNOYING]


def _pick_sql(xs, index: str) -> str:
    return f"([{_values(xs)[1:-1]}])[{index} % {len(xs)} + 1]"


#: All entries of the tables in turn, topics and descriptions in other places and letters, those that go by their topic, and texts without any.
VARIANT = f"""CASE p_partkey % 6 WHEN 0 THEN {_pick_sql(_T.OVERRIDES, "p_partkey // 6")} WHEN 1 THEN upper({_pick_sql(_T.PREFIXES, "p_partkey // 6")}) || ' : ' || p_name
 WHEN 2 THEN p_type || ':  ' || {_pick_sql(_T.SUFFIXES, "p_partkey // 6")} WHEN 3 THEN {_pick_sql(_T.PREFIXES, "p_partkey // 6")} || ': ' || upper({_pick_sql(_T.SUFFIXES, "p_partkey // 6")})
 WHEN 4 THEN {_pick_sql(_RULED[0], "p_partkey // 6")} || ': ' || {_pick_sql(_RULED[1], "p_size")} ELSE lower(p_type) || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE ': ' END || p_name END"""


def _variants(part: DataFrame) -> DataFrame:
    """p_partkey, text: the same in Spark."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    sixth, kind = F.floor(F.col("p_partkey") / 6), F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, pick(_T.OVERRIDES, sixth))
        .when(kind == 1, F.concat(F.upper(pick(_T.PREFIXES, sixth)), F.lit(" : "), "p_name"))
        .when(kind == 2, F.concat("p_type", F.lit(":  "), pick(_T.SUFFIXES, sixth)))
        .when(kind == 3, F.concat(pick(_T.PREFIXES, sixth), F.lit(": "), F.upper(pick(_T.SUFFIXES, sixth))))
        .when(kind == 4, F.concat(pick(_RULED[0], sixth), F.lit(": "), pick(_RULED[1], F.col("p_size"))))
        .otherwise(F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, " ").otherwise(": "), "p_name"))
    )
    return part.select("p_partkey", text.alias("text"))


_PRAISED = f"WHEN head IN {_values(_T.FUN)} THEN 'fun' WHEN head IN {_values(_T.SATISFYING)} THEN 'satisfying' WHEN head IN {_values(_T.BEAUTIFUL)} THEN 'beautiful'"
CANONICAL = f"""{_lookup("ov", _T.OVERRIDES)}, {_lookup("pre", _T.PREFIXES)}, {_lookup("suf", _T.SUFFIXES)},
v AS (SELECT p_partkey, {VARIANT} AS text FROM part),
s AS (SELECT *, instr(text, ': ') AS cut, substr(text, 1, instr(text, ': ') - 1) AS h, substr(text, instr(text, ': ') + 2) AS t FROM v),
m AS (SELECT s.p_partkey, s.text, s.cut, ov.v AS whole, coalesce(pre.v, upper(substr(h, 1, 1)) || substr(h, 2)) AS head, coalesce(suf.v, t) AS tail, lower(trim(coalesce(suf.v, t))) AS low
 FROM s LEFT JOIN ov ON ov.k = s.text LEFT JOIN pre ON pre.k = lower(trim(h)) LEFT JOIN suf ON suf.k = lower(trim(t))),
c AS (SELECT p_partkey, text, CASE WHEN whole IS NOT NULL THEN whole WHEN cut = 0 THEN text ELSE head || ': ' || CASE
 WHEN low IN {_values(_T.PRAISE)} THEN CASE {_PRAISED} WHEN head IN {_values(_T.GOOD)} THEN 'good' ELSE tail END
 WHEN low = 'good' THEN CASE {_PRAISED} ELSE tail END
 WHEN low IN {_values(_T.UNEVEN)} THEN CASE WHEN head IN {_values(_T.UNEVEN_TOPICS)} THEN 'skill disparity' ELSE tail END
 WHEN low IN {_values(_T.ANNOYING)} THEN CASE WHEN head IN {_values(_T.COMBAT)} THEN 'unfun to play against' ELSE 'annoying' END
 ELSE tail END END AS canonical FROM m)"""


@query(f"WITH {CANONICAL} SELECT p_partkey, text, canonical FROM c")
def normalize_text(spark, d):
    return canonicalised(_variants(table(spark, d, "part")))


@query(f"WITH {CANONICAL} SELECT count(DISTINCT text) AS before, count(DISTINCT canonical) AS after, count(*) FILTER (text <> canonical) AS changed, round(CAST(count(DISTINCT text) - count(DISTINCT canonical) AS DOUBLE) / count(DISTINCT text) * 100, 1) AS reduction_pct FROM c")
def normalize_effect(spark, d):
    return quality.change_effect(canonicalised(_variants(table(spark, d, "part"))), "text", "canonical")


#: For SQL, whose word boundaries know ASCII only: other letters and digits become "_", other signs blanks.
PLAIN = """t AS MATERIALIZED (SELECT doc_id, sentiment, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}\\p{M}°]', ' ', 'g'), '[^\\x00-\\x7F°]', '_', 'g') AS text FROM fb)"""


def _hit(*patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in patterns) + ")"


def _tags_sql(rules: dict[str, list[str]]) -> str:
    return "[" + ", ".join(f"CASE WHEN {_hit(*ps)} THEN '{n}' END" for n, ps in rules.items()) + "]"


@query(f"WITH {PLAIN} SELECT doc_id, array_to_string(list_filter(CASE WHEN sentiment = 'negative' THEN {_tags_sql(rule_tables.NEGATIVE)} ELSE {_tags_sql(rule_tables.POSITIVE)} END, lambda x: x IS NOT NULL), ',') AS tags FROM t")
def regex_tagger(spark, d):
    sides = list(rule_tables.NEGATIVE.items()), list(rule_tables.POSITIVE.items())
    rows, bare, known = textfn.prepared(views.feedback(spark, d).select("doc_id", "sentiment", "text"), [p for rules in sides for _, ps in rules for p in ps])
    found = textfn.tags_by_side(F.col("text"), F.col("sentiment") == "negative", *sides, bare, known)
    return rows.select("doc_id", F.array_join(found, ",").alias("tags"))


_WIDE = [{n: [p for p in ps if not p.isascii()] for n, ps in rules.items() if any(not p.isascii() for p in ps)} for rules in (rule_tables.NEGATIVE, rule_tables.POSITIVE)]
#: A text for each pattern with other letters than ASCII; as it is, in capitals, and inside a word.
_EXAMPLES = [t for rules in _WIDE for ps in rules.values() for p in ps for e in [textfn.example(p)] for t in (e, e.upper(), f"ж{e}ж")]


def _marked(pattern: str) -> str:
    """A pattern for texts with marks around each Unicode word: SQL's own word boundaries know ASCII only."""
    out = pattern.replace("\\s", "[\\s‹›]").replace(" ", "[‹›]* [‹›]*").replace("\\b", "[‹›]").replace("\\w", "[\\p{L}\\p{M}\\p{N}_]")
    return re.sub(r"(?<!\\)\.(?!\*)", "[‹›]*.[‹›]*", out)


@query(f"""WITH t AS MATERIALIZED (SELECT doc_id, regexp_replace(text || ' ' || ([{", ".join(f"'{e}'" for e in _EXAMPLES)}])[doc_id % {len(_EXAMPLES)} + 1] || ' .', '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', '‹\\1›', 'g') AS text FROM documents WHERE doc_id IS NOT NULL)
 SELECT doc_id, array_to_string(list_filter({_tags_sql({f"{side} {n}": [_marked(p) for p in ps] for side, rules in zip(("negative", "positive"), _WIDE, strict=True) for n, ps in rules.items()})}, lambda x: x IS NOT NULL), ',') AS tags FROM t""")
def wide_tagger(spark, d):
    """Rules with other letters than ASCII over every text, each with an example of one of their patterns."""
    example = F.element_at(F.array(*map(F.lit, _EXAMPLES)), (F.col("doc_id") % len(_EXAMPLES) + 1).cast("int"))
    rows = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", F.concat("text", F.lit(" "), example, F.lit(" .")).alias("text"))
    rules = [(f"{side} {n}", ps) for side, own in zip(("negative", "positive"), _WIDE, strict=True) for n, ps in own.items()]
    rows, bare, known = textfn.prepared(rows, [p for _, ps in rules for p in ps])
    return rows.select("doc_id", F.array_join(textfn.tags(F.col("text"), rules, bare, known), ",").alias("tags"))


@query(f"WITH {PLAIN} " + " UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'positive') AS positive, count(*) AS total FROM t WHERE {_hit(p)} HAVING count(*) > 0" for t, p in rule_tables.TERMS.items()))
def term_frequency(spark, d):
    return textmining.term_frequency(views.feedback(spark, d), rule_tables.TERMS)


@query(f"WITH {PLAIN} " + " UNION ALL ".join(f"SELECT '{n}' AS theme, count(*) FILTER ({_hit(*ps)}) AS n, " + PCT.format(f"count(*) FILTER ({_hit(*ps)})", "count(*)") + " AS pct FROM t WHERE sentiment IS NULL" for n, ps in rule_tables.THEMES.items()))
def theme_match(spark, d):
    return textmining.themes(views.feedback(spark, d).filter("sentiment is null"), rule_tables.THEMES)


@query(f"WITH {PLAIN}, m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS theme, doc_id FROM t WHERE sentiment IS NULL AND {_hit(*ps)}" for n, ps in rule_tables.THEMES.items()) + ") " + top_sql("SELECT theme, m.doc_id, substr(d.text, 1, 200) AS sample FROM m JOIN documents d ON d.doc_id = m.doc_id", "theme", "doc_id", 3, "theme, doc_id, sample, rank"))
def theme_samples(spark, d):
    return textmining.theme_samples(views.feedback(spark, d).filter("sentiment is null"), rule_tables.THEMES, "doc_id")


@query("SELECT doc_id, length(text) >= 20 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / CAST(length(text) AS DOUBLE) > 0.35 AS readable FROM documents")
def readable_text(spark, d):
    return table(spark, d, "documents").select("doc_id", textfn.readable(F.col("text")).alias("readable"))


def _gram_sql(n: int, top: int) -> str:
    stop = ", ".join(f"'{w}'" for w in textfn.STOP_WORDS)
    clean = "regexp_replace(regexp_replace(lower(text), 'https?://[^ \\t\\n\\r\\f\\v]+', '', 'g'), '[^a-z \\t\\n\\r\\f\\v]', ' ', 'g')"
    return f"""WITH w AS (SELECT list_filter(regexp_split_to_array({clean}, '[ \\t\\n\\r\\f\\v]+'), lambda x: length(x) > 1 AND x NOT IN ({stop})) AS w FROM documents WHERE lang = 'en')
 SELECT gram, count(*) AS n FROM (SELECT array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})) GROUP BY gram ORDER BY n DESC, gram LIMIT {top}"""


@query(_gram_sql(2, 50))
def top_bigrams(spark, d):
    return textmining.top_ngrams(table(spark, d, "documents").filter("lang = 'en'"), 2, 50)


@query(_gram_sql(3, 40))
def top_trigrams(spark, d):
    return textmining.top_ngrams(table(spark, d, "documents").filter("lang = 'en'"), 3, 40)


@query("SELECT coalesce(sentiment, 'none') AS side, count(*) FILTER (length(text) >= 20) AS kept, count(*) FILTER (length(text) < 20) AS excluded FROM fb GROUP BY 1")
def length_filter(spark, d):
    long = F.length("text") >= 20
    return views.feedback(spark, d).groupBy(F.coalesce("sentiment", F.lit("none")).alias("side")).agg(numbers.count_if(long).alias("kept"), numbers.count_if(~long).alias("excluded"))


@query("WITH b(ord, lo, hi, bucket) AS (VALUES " + ", ".join(f"({i}, {lo}, {hi if hi is not None else 1 << 40}, '{n}')" for i, (lo, hi, n) in enumerate(textmining.LENGTHS)) + ") SELECT ord, bucket, count(doc_id) AS n, " + PCT.format("count(doc_id)", "(SELECT count(*) FROM documents)") + " AS pct FROM b LEFT JOIN documents ON length(text) >= lo AND length(text) < hi GROUP BY ord, bucket")
def length_histogram(spark, d):
    return textmining.length_histogram(table(spark, d, "documents"))


@query("SELECT lang, n, round(CAST(n AS DOUBLE) / sum(n) OVER () * 100, 1) AS pct FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ORDER BY n DESC, lang LIMIT 15")
def language_breakdown(spark, d):
    rows = rank.counted(table(spark, d, "documents"), "lang")
    return rank.top_rows(rank.with_share(rows, []), [F.desc("n"), F.asc("lang")], 15)


@query("SELECT doc_id, lang, 'short' AS part FROM fb WHERE sentiment IS NULL AND n_chars < 1000 UNION ALL SELECT doc_id, lang, 'long' FROM fb WHERE sentiment IS NULL AND n_chars >= 1000")
def unclassified_rows(spark, d):
    rows = views.feedback(spark, d).filter("sentiment is null")
    return rows.filter("n_chars < 1000").select("doc_id", "lang", F.lit("short").alias("part")).unionByName(rows.filter("n_chars >= 1000").select("doc_id", "lang", F.lit("long").alias("part")))


@query("SELECT doc_id, n_chars, substr(text, 1, 500) AS text FROM documents WHERE lang = 'en' AND n_chars > 200 ORDER BY n_chars DESC, doc_id LIMIT 20")
def long_text_top(spark, d):
    rows = table(spark, d, "documents").filter("lang = 'en' and n_chars > 200")
    return rank.top_rows(rows, [F.desc("n_chars"), F.asc("doc_id")], 20).select("doc_id", "n_chars", F.substring("text", 1, 500).alias("text"))


@query(f"SELECT page_id, {pages.plain_text_sql('html')} AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query("SELECT href, page_id FROM (SELECT href, page_id, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS k FROM (SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))) WHERE k = 1")
def html_links(spark, d):
    return pages.links(table(spark, d, "pages")).select("href", "page_id")


# --- shape and cleaning ---


@query("SELECT o_orderkey, c_name, n_name, round(o_totalprice / 60, 1) AS hours, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def proj_flatten(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    nested = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "o_totalprice", "o_orderdate", F.struct("c_name", "n_name").alias("author"))
    return nested.select("o_orderkey", "author.c_name", "author.n_name", F.round(F.col("o_totalprice") / 60, 1).alias("hours"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))


@query("SELECT rec_id, sentiment, bracket, strftime(ts, '%Y-%m') AS month, season, hours, votes_up FROM rec")
def proj_derived(spark, d):
    return views.records(spark, d).select("rec_id", "sentiment", "bracket", time.month(F.col("ts")).alias("month"), "season", "hours", "votes_up")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INDUSTRY' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def recode_values(spark, d):
    return shape.recoded(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"INDUSTRY": ["BUILDING", "MACHINERY"]})


@query("SELECT rec.rec_id, sentiment, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags, count(tag) AS n_tags FROM rec LEFT JOIN tag ON tag.rec_id = rec.rec_id GROUP BY 1, 2")
def join_tags(spark, d):
    sets = views.tagged(spark, d).groupBy("rec_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    rows = views.records(spark, d).select("rec_id", "sentiment").join(sets, "rec_id", "left")
    return rows.select("rec_id", "sentiment", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"), F.coalesce(F.size("tags"), F.lit(0)).cast("long").alias("n_tags"))


@query("SELECT o_orderkey, coalesce(tag, 'none') AS tag FROM orders LEFT JOIN (SELECT l_orderkey, l_shipmode AS tag FROM (SELECT l_orderkey, l_linestatus || l_returnflag AS l_shipmode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k FROM lineitem) WHERE k = 1) ON l_orderkey = o_orderkey")
def merge_results(spark, d):
    """Lines of an order repeat numbers, which the SQL leaves open: the first by file and row counts, however the files are split."""
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.concat("l_linestatus", "l_returnflag").alias("tag"), *place)
    return shape.merged_results(table(spark, d, "orders").select("o_orderkey"), results, "o_orderkey", "l_linenumber", {"tag": F.lit("none")}, [F.asc("file"), F.asc("row")]).select("o_orderkey", "tag")


MAPPING = [(s, t, t.lower()) for s in ("negative", "positive") for t in ("STANDARD", "SMALL", "LARGE", "PROMO")]


@query("WITH m(sentiment, topic, tag) AS (VALUES " + ", ".join(map(str, MAPPING)) + """), own AS (SELECT rec.rec_id, rec.sentiment, list_sort(list_distinct(list(topic) FILTER (topic IS NOT NULL))) AS tags FROM rec LEFT JOIN iss ON iss.rec_id = rec.rec_id AND iss.kind = CASE rec.sentiment WHEN 'negative' THEN 'complaint' ELSE 'praise' END GROUP BY 1, 2),
 inf AS (SELECT own.rec_id, list_sort(list_distinct(list(m.tag))) AS tags FROM own JOIN iss ON iss.rec_id = own.rec_id JOIN m ON m.sentiment = own.sentiment AND m.topic = iss.topic WHERE len(coalesce(own.tags, [])) = 0 GROUP BY 1)
 SELECT own.rec_id, array_to_string(CASE WHEN len(coalesce(own.tags, [])) = 0 THEN coalesce(inf.tags, []) ELSE own.tags END, ',') AS tags FROM own LEFT JOIN inf ON inf.rec_id = own.rec_id""")
def backfill_tags(spark, d):
    rows, found = views.records(spark, d).select("rec_id", "sentiment"), views.issues(spark, d)
    of_kind = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("topic")))
    sets = found.groupBy("rec_id").agg(of_kind("complaint").alias("negative"), of_kind("praise").alias("positive"), F.collect_set("topic").alias("topics"))
    own = F.when(F.col("sentiment") == "negative", F.col("negative")).otherwise(F.col("positive"))
    rows = rows.join(sets, "rec_id", "left").withColumn("tags", F.array_sort(F.coalesce(own, F.array().cast("array<string>"))))
    return tags.backfilled_by(rows, MAPPING).select("rec_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id, sentiment IS NOT NULL OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 25 AS worth FROM fb")
def worth_processing(spark, d):
    known = F.when(F.col("sentiment").isNotNull(), F.array("sentiment")).otherwise(F.array().cast("array<string>"))
    return views.feedback(spark, d).select("doc_id", shape.worth_processing(known, F.col("text"), 25).alias("worth"))


@query("SELECT rec_id, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (tag IN ('STANDARD', 'PROMO', 'SMALL')), '') AS kept, count(*) FILTER (tag NOT IN ('STANDARD', 'PROMO', 'SMALL')) AS violations FROM tag GROUP BY rec_id")
def allowlist_filter(spark, d):
    rows = views.tagged(spark, d).groupBy("rec_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return tags.allowed(rows, "tags", ["STANDARD", "PROMO", "SMALL"]).select("rec_id", F.array_join("kept", ",").alias("kept"), "violations")


@query("SELECT rec_id, line, substr(text, 1, 12) AS text, CASE WHEN votes % 3 = 0 THEN 'complaint' ELSE kind END AS type, CASE WHEN votes % 2 = 0 THEN entity ELSE '' END AS entities, votes > 25 AS \"primary\" FROM iss WHERE votes % 7 <> 0")
def sanitize_struct(spark, d):
    v = F.col("votes")
    raw = F.struct(
        F.when(v % 7 == 0, "").otherwise(F.col("text")).alias("text"), F.when(v % 3 == 0, "bogus").otherwise(F.col("kind")).alias("type"),
        F.when(v % 2 == 0, F.array("entity")).alias("entities"), F.when(v > 25, True).alias("primary"), F.lit(None).cast("string").alias("season_ref"),
    )
    rows = views.issues(spark, d).select("rec_id", "line", F.explode(shape.sanitised(F.array(raw), 12)).alias("i"))
    return rows.select("rec_id", "line", "i.text", "i.type", F.array_join("i.entities", ",").alias("entities"), "i.primary")


@query("SELECT event_id, event_type AS cat, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS conf FROM events")
def parse_model_json(spark, d):
    key, level = F.when(F.col("event_id") % 3 == 0, "categories").otherwise("cats"), F.when(F.col("event_id") % 2 == 0, "high").otherwise("low")
    body = F.concat(F.lit('{"'), key, F.lit('": ["'), F.col("event_type"), F.lit('"], "conf": "'), level, F.lit('"}'))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = table(spark, d, "events").select("event_id", shape.model_reply(reply, "cats array<string>, categories array<string>, conf string, confidence string").alias("r"))
    return rows.select("event_id", F.coalesce("r.cats", "r.categories")[0].alias("cat"), F.coalesce("r.conf", "r.confidence").alias("conf"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_props(spark, d):
    return table(spark, d, "events").select("event_id", shape.literal_struct(F.col("props"), "k long").getField("k").alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_dates(spark, d):
    ts, out = F.col("o_orderdate"), F
    for i, f in enumerate(time.DATE_FORMATS):
        out = out.when(F.col("o_orderkey") % 6 == i, F.date_format(ts, f))
    return table(spark, d, "orders").select("o_orderkey", time.parse_date(out.otherwise("soon")).alias("day"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'S' || p_size WHEN 1 THEN 'S1' WHEN 2 THEN '' ELSE 'S1' END AS season FROM part")
def version_season(spark, d):
    version = F.expr("CASE p_size % 4 WHEN 0 THEN concat(p_size, '.2.1') WHEN 1 THEN 'Season_1' WHEN 2 THEN 'beta' ELSE '1.2.0' END")
    return table(spark, d, "part").select("p_partkey", time.season_code(version).alias("season"))


@query("SELECT text, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, d):
    return shape.deduplicated(table(spark, d, "documents").select("text", "doc_id", "n_chars", "source"), "text", ["source", "doc_id"]).select("text", "doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return shape.pending(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("SELECT rec_id, votes_up, 'helpful' AS list FROM (SELECT * FROM rec ORDER BY votes_up DESC, rec_id LIMIT 100) WHERE votes_up > 0 UNION ALL SELECT rec_id, votes_up, 'least' FROM (SELECT * FROM rec ORDER BY votes_up, rec_id LIMIT 500) WHERE votes_up > 0")
def top_records(spark, d):
    rows = views.records(spark, d).select("rec_id", "votes_up")
    most, least = rank.top_rows(rows, [F.desc("votes_up"), F.asc("rec_id")], 100), rank.top_rows(rows, [F.asc("votes_up"), F.asc("rec_id")], 500)
    return most.filter("votes_up > 0").withColumn("list", F.lit("helpful")).unionByName(least.filter("votes_up > 0").withColumn("list", F.lit("least")))


@query("SELECT tag FROM rt WHERE sentiment = 'negative' AND bracket = '0-10h (Newcomer)' INTERSECT SELECT tag FROM rt WHERE sentiment = 'positive'")
def tag_overlap(spark, d):
    rows = views.record_tags(spark, d)
    return rows.filter("sentiment = 'negative' and bracket = '0-10h (Newcomer)'").select("tag").intersect(rows.filter("sentiment = 'positive'").select("tag"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS moving_avg FROM events")
def moving_avg_50(spark, d):
    rows = rank.moving_average(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "value", 50)
    return rows.select("event_id", "user_id", F.round("moving_avg", 9).alias("moving_avg"))


@query("SELECT event_id, user_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def running_total(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rank.running_total(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")], "k").select("event_id", "user_id", "running")


@query("SELECT event_id FROM events WHERE (event_id - 7) % 40 = 0 OR (event_id < 7 AND (event_id + 33) % 40 = 0)")
def strided_sample(spark, d):
    return sampling.strided(table(spark, d, "events").select("event_id"), "event_id", 40, 7)


@query("SELECT DISTINCT p_brand AS entity, CAST(len(list_distinct(list(p_type))) AS BIGINT) AS n_types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def dim_entity_flatten(spark, d):
    nested = table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("brands"))
    rows = nested.select("p_type", F.explode("brands").alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("n_types"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 3")
def scan_jsonl(spark, d):
    """Events written as JSON lines, some of them broken or empty, and read back from the files."""
    line = F.when(F.col("event_id") % 20 == 3, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).when(F.col("event_id") % 10 == 3, F.lit(""))
    lines = table(spark, d, "events").select(line.otherwise(F.to_json(F.struct("event_id", "event_type", "value"))).alias("value"))
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex[:12]}"
    lines.write.text(folder)
    return readers.jsonl(spark, folder, "event_id long, event_type string, value double")


@query(f"""SELECT page_id, version, season, text FROM (SELECT page_id, version, text, CASE WHEN version IN ('Season_1', '1.2.0') THEN 'S1' WHEN regexp_matches(version, '^[0-9]+\\.') THEN 'S' || regexp_extract(version, '^([0-9]+)\\.', 1) ELSE '' END AS season
 FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Season_1' WHEN 1 THEN '1.2.0' WHEN 2 THEN CAST(page_id % 9 + 1 AS VARCHAR) || '.4.0' WHEN 3 THEN 'beta-' || CAST(page_id AS VARCHAR) ELSE 'Update' END AS version,
 {pages.plain_text_sql("CASE WHEN page_id % 7 = 3 THEN '<nav>only a menu</nav>' ELSE html END")} AS text FROM pages)) WHERE text <> '' AND season <> '' AND NOT regexp_matches(version, '^beta')""")
def page_versions(spark, d):
    """Pages of released versions that have a text and a season."""
    version = F.when(F.col("page_id") % 5 == 0, "Season_1").when(F.col("page_id") % 5 == 1, "1.2.0").when(F.col("page_id") % 5 == 2, F.concat((F.col("page_id") % 9 + 1).cast("string"), F.lit(".4.0")))
    version = version.when(F.col("page_id") % 5 == 3, F.concat(F.lit("beta-"), F.col("page_id").cast("string"))).otherwise("Update")
    html = F.when(F.col("page_id") % 7 == 3, "<nav>only a menu</nav>").otherwise(F.col("html"))
    return pages.released(table(spark, d, "pages").select("page_id", version.alias("version"), html.alias("html")), exclude="^beta")


_TAGGERS = {
    "by_kind": ("array_distinct(collect_list(kind))", "list_distinct(list(kind ORDER BY line))"),
    "by_topic": ("array_distinct(collect_list(topic))", "list_distinct(list(topic ORDER BY line))"),
    "by_both": ("array_distinct(collect_list(CASE WHEN line % 2 = 0 THEN kind ELSE topic END))", "list_distinct(list(CASE WHEN line % 2 = 0 THEN kind ELSE topic END ORDER BY line))"),
}


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, rec_id, {own} AS tags FROM iss GROUP BY rec_id" for m, (_, own) in _TAGGERS.items()) + """),
 p AS (SELECT a.model AS model_a, b.model AS model_b, len(list_intersect(a.tags, b.tags)) AS c, len(list_distinct(a.tags || b.tags)) AS u FROM l a JOIN l b ON a.rec_id = b.rec_id AND a.model < b.model)
 SELECT model_a, model_b, count(*) AS n, count(*) FILTER (c = u) AS same, round(avg(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE c::DOUBLE / u END), 4) AS overlap, """ + PCT.format("count(*) FILTER (c = u)", "count(*)") + " AS same_pct FROM p GROUP BY 1, 2")
def model_agreement(spark, d):
    """What three ways of tagging records agree on, pair by pair."""
    rows = views.issues(spark, d)
    labels = None
    for model, (own, _) in _TAGGERS.items():
        each = rows.groupBy(F.col("rec_id").alias("key")).agg(F.expr(own).alias("tags")).select(F.lit(model).alias("model"), "key", "tags")
        labels = each if labels is None else labels.unionByName(each)
    return agreement.pairwise(labels)


# --- data quality, sampling ---


@query("SELECT coalesce(level, 'none') AS level, count(*) AS n, (SELECT count(*) FROM fb) AS total, (SELECT count(*) FROM fb WHERE sentiment IS NOT NULL) AS covered, (SELECT round(CAST(count(*) FILTER (sentiment IS NOT NULL) AS DOUBLE) / count(*) * 100, 1) FROM fb) AS covered_pct FROM (SELECT CASE WHEN sentiment IS NOT NULL THEN CASE WHEN n_chars > 2000 THEN 'high' ELSE 'low' END END AS level FROM fb) GROUP BY 1")
def dq_coverage(spark, d):
    known = F.col("sentiment").isNotNull()
    rows = views.feedback(spark, d).select(known.alias("known"), F.when(known, F.when(F.col("n_chars") > 2000, "high").otherwise("low")).alias("level"))
    return quality.coverage(rows, "known", "level")


@query("WITH a AS (SELECT o_orderkey AS k, o_orderdate AS v FROM orders), b AS (SELECT l_orderkey AS k, min(l_shipdate) AS v FROM lineitem GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def dq_alignment(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("v"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").alias("v"))
    return quality.misaligned(a, b, "k", "v")


@query("SELECT entity, count(*) AS n FROM iss WHERE lower(entity) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size > 48) GROUP BY 1")
def entity_unmatched(spark, d):
    known = table(spark, d, "part").filter("p_size > 48").select(F.upper("p_brand").alias("name"))
    return quality.unmatched(views.issues(spark, d), "entity", known, "name")


@query("""WITH c AS (SELECT topic AS g, bracket AS s, rec_id * 10 + line AS k, text FROM ri), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g, s ORDER BY CASE WHEN length(text) BETWEEN 60 AND 600 THEN 1 ELSE 0 END DESC, md5(k || '-42'), k) AS INTEGER) AS pick FROM c WHERE length(trim(text)) > 0),
 z AS (SELECT g, s, count(*) AS n FROM c WHERE length(trim(text)) > 0 GROUP BY 1, 2), y AS (SELECT *, sum(n) OVER (PARTITION BY g) AS total, count(*) OVER (PARTITION BY g) AS present, row_number() OVER (PARTITION BY g ORDER BY n DESC, s) AS place FROM z),
 x AS (SELECT *, CAST(1 + round(CAST(n AS DOUBLE) / total * (15 - present), 0) AS INTEGER) AS slot FROM y), w AS (SELECT g, s, greatest(slot + CASE WHEN place = 1 THEN 15 - sum(slot) OVER (PARTITION BY g) ELSE 0 END, 0) AS slot FROM x)
 SELECT r.g, r.s, r.k, r.pick FROM r JOIN w ON w.g = r.g AND w.s = r.s WHERE pick <= 20 AND pick <= slot""")
def stratified_sample(spark, d):
    rows = views.record_issues(spark, d).select(F.col("topic").alias("g"), F.col("bracket").alias("s"), (F.col("rec_id") * 10 + F.col("line")).alias("k"), "text")
    return sampling.stratified(rows, "g", "s", "k", "text").select("g", "s", "k", "pick")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS negative FROM events GROUP BY 1")
def event_timeline(spark, d):
    from feedback_engine.streaming.incremental import timeline

    return timeline(table(spark, d, "events"))
