"""The relations of the engine over a folder of star-schema tables, in Spark and in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import BRACKETS, bracket
from feedback_engine.operators.periods import with_period

SEASONS = [(i, f"Season {i}", datetime.datetime(1995 + i // 2, 1 + 6 * (i % 2), 1), datetime.datetime(1995 + (i + 1) // 2, 1 + 6 * ((i + 1) % 2), 1)) for i in range(10)]
HIGH = ("1-URGENT", "2-HIGH")
KIND_OF = {"A": "complaint", "N": "suggestion", "R": "praise"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEASONS, "ord int, season string, start_ts timestamp_ntz, end_ts timestamp_ntz")


def records(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, ts, sentiment, language, hours, votes_up, hc, ord, season, bracket."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    rows = joined.select(
        F.col("o_orderkey").alias("rec_id"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "negative").otherwise("positive").alias("sentiment"),
        F.col("n_name").alias("language"),
        F.round(F.col("o_totalprice") / 500, 1).alias("hours"),
        F.pmod(F.floor("o_totalprice"), F.lit(1000)).cast("long").alias("votes_up"),
        F.col("o_orderpriority").isin(*HIGH).alias("hc"),
    )
    return with_period(rows, SEASONS).withColumn("bracket", bracket(F.col("hours")))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, tag: the distinct tags of each record."""
    return issues(spark, d).select("rec_id", F.col("topic").alias("tag")).distinct()


def issues(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, line, text, topic, kind, entity, votes."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    kind = F
    for flag, name in list(KIND_OF.items())[:-1]:
        kind = kind.when(F.col("l_returnflag") == flag, name)
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("rec_id"),
        F.col("l_linenumber").alias("line"),
        F.concat_ws(": ", "p_type", "p_name").alias("text"),
        F.col("p_type").alias("topic"),
        kind.otherwise(list(KIND_OF.values())[-1]).alias("kind"),
        F.col("p_brand").alias("entity"),
        F.col("l_quantity").cast("long").alias("votes"),
    )


def record_tags(spark: SparkSession, d: str) -> DataFrame:
    """records with each of their tags."""
    return records(spark, d).join(tagged(spark, d), "rec_id")


def record_issues(spark: SparkSession, d: str) -> DataFrame:
    """issues with their record."""
    return issues(spark, d).join(records(spark, d), "rec_id")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars, sentiment (null where nothing is known)."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    side = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", side.alias("sentiment"))


SQL_BRACKET = "CASE " + " ".join(f"WHEN {{0}} < {b} THEN '{n}'" for b, n in BRACKETS[:-1]) + f" ELSE '{BRACKETS[-1][1]}' END"
SQL = {
    "season": "season(ord, season, start_ts, end_ts) AS (VALUES " + ", ".join(f"({o}, '{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for o, n, a, b in SEASONS) + ")",
    "rec": f"""rec AS (SELECT *, {SQL_BRACKET.format("hours")} AS bracket FROM (SELECT o_orderkey AS rec_id, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'negative' ELSE 'positive' END AS sentiment,
 n_name AS language, round(o_totalprice / 500, 1) AS hours, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS votes_up, o_orderpriority IN {HIGH} AS hc, s.ord, coalesce(s.season, 'Off-season') AS season
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN season s ON o_orderdate >= s.start_ts AND o_orderdate < s.end_ts))""",
    "iss": """iss AS (SELECT l_orderkey AS rec_id, l_linenumber AS line, p_type || ': ' || p_name AS text, p_type AS topic,
 CASE l_returnflag WHEN 'A' THEN 'complaint' WHEN 'N' THEN 'suggestion' ELSE 'praise' END AS kind, p_brand AS entity, CAST(l_quantity AS BIGINT) AS votes FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "tag": "tag AS (SELECT DISTINCT rec_id, topic AS tag FROM iss)",
    "rt": "rt AS (SELECT rec.*, tag.tag FROM rec JOIN tag USING (rec_id))",
    "ri": "ri AS (SELECT iss.*, rec.ts, rec.sentiment, rec.language, rec.hours, rec.ord, rec.season, rec.bracket FROM iss JOIN rec USING (rec_id))",
    "fb": "fb AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS sentiment FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
}
ORDER = ("season", "rec", "iss", "tag", "rt", "ri", "fb")


def sql(body: str) -> str:
    """body after the views it names, so that it runs on the tables alone."""
    import re

    needs: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for v in ORDER:
            if v not in needs and re.search(rf"\b(?:FROM|JOIN|,)\s+{v}\b", text):
                needs.add(v)
                todo.append(SQL[v])
    with_ = ",\n".join(SQL[v] for v in ORDER if v in needs)
    body = body.strip()
    if not with_:
        return body
    return f"WITH {with_},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {with_}\n{body}"
