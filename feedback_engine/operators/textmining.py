"""Term, theme and n-gram mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.numbers import count_if, percent
from feedback_engine.functions.text import any_match, ngrams, prepared, spread, tags
from feedback_engine.operators.rank import top_per_group

#: Lengths from the first bound, below the second.
LENGTHS = (
    (0, 5, "0-5 chars (empty/meme)"),
    (5, 20, "5-20 chars (very short)"),
    (20, 50, "20-50 chars (short)"),
    (50, 100, "50-100 chars"),
    (100, 200, "100-200 chars"),
    (200, 500, "200-500 chars"),
    (500, 1000, "500-1000 chars"),
    (1000, None, "1000+ chars"),
)


def term_frequency(df: DataFrame, terms: dict[str, str], text: str = "text", side: str = "sentiment") -> DataFrame:
    """How many negative, positive and all texts hold each term; one pass over the texts."""
    own, bare, known = prepared(df.select(side, F.col(text).alias("text")), terms.values())
    hits = F.array(*[F.when(any_match(F.col("text"), [p], bare, known), F.lit(x)) for x, p in terms.items()])
    rows = own.select(side, F.explode(hits).alias("term")).filter("term is not null")
    return rows.groupBy("term").agg(count_if(F.col(side) == "negative").alias("negative"), count_if(F.col(side) == "positive").alias("positive"), F.count("*").alias("total"))


def themes(df: DataFrame, rules: dict[str, Sequence[str]], text: str = "text") -> DataFrame:
    """Texts that match a theme, in percent of all."""
    own, bare, known = prepared(df.select(F.col(text).alias("text")), [p for ps in rules.values() for p in ps])
    flags = [count_if(any_match(F.col("text"), p, bare, known)).alias(f"m{i}") for i, p in enumerate(rules.values())]
    one = own.agg(F.count("*").alias("total"), *flags)
    pairs = F.array(*[F.struct(F.lit(name).alias("theme"), F.col(f"m{i}").alias("n")) for i, name in enumerate(rules)])
    return one.select("total", F.explode(pairs).alias("p")).select("p.theme", "p.n", percent(F.col("p.n"), F.col("total")).alias("pct"))


def theme_samples(df: DataFrame, rules: dict[str, Sequence[str]], key: str, n: int = 3, longest: int = 200, text: str = "text") -> DataFrame:
    """The first n texts (by key) of each theme, cut to `longest` characters."""
    own, bare, known = prepared(df.select(key, F.col(text).alias("text")), [p for ps in rules.values() for p in ps])
    hits = own.select(key, "text", F.explode(tags(F.col("text"), list(rules.items()), bare, known)).alias("theme"))
    return top_per_group(hits.select("theme", key, F.substring("text", 1, longest).alias("sample")), ["theme"], [F.asc(key)], n)


def top_ngrams(df: DataFrame, n: int, top: int, text: str = "text") -> DataFrame:
    """The most frequent n-grams, ties to the smaller."""
    grams = spread(df.select(text)).select(F.explode(ngrams(F.col(text), n)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(top)


def length_histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts in each range of lengths, in percent of all; empty ranges stay."""
    n = F.length(text)
    inside = lambda lo, hi: (n >= lo) & (n < hi) if hi is not None else n >= lo
    one = df.agg(F.count("*").alias("total"), *[count_if(inside(lo, hi)).alias(f"b{i}") for i, (lo, hi, _) in enumerate(LENGTHS)])
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("bucket"), F.col(f"b{i}").alias("n")) for i, (_, _, label) in enumerate(LENGTHS)])
    return one.select("total", F.explode(pairs).alias("p")).select("p.ord", "p.bucket", "p.n", percent(F.col("p.n"), F.col("total")).alias("pct"))
