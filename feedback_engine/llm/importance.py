"""Target-distribution importance resampling.

Each document is weighed by how much likelier its n-grams are in a target corpus
than in its own: n-grams are hashed into buckets, a bucket's gain is the
logarithm of the ratio of its smoothed shares, and a document's weight is the sum
of its n-grams' gains. Weights with Gumbel noise, made from the ids, are scores;
the highest scores are a sample without replacement in proportion to the
likelihood ratios.

The position table has a row for each word of each document (posexplode). For
orders above 1, a window over a document's positions gives the words that follow
(lead), which are joined to the n-gram of each order. N-grams are hashed to buckets and grouped by
them for both corpora's counts; the gain of its bucket, one of `buckets` rows, is
joined to each n-gram, and gains are summed by document. Counts and gains are
added up in each task before they travel. Places are found by range partitions
and the sums before them, so no task sees all scores.

Defined cases: a null text has no words; a null id is an empty one in the noise
and comes last among equal scores; rows that repeat an id are documents of their
own; only the text and id columns are read; an empty table gives an empty one, an
empty target gives gains by the documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_engine.llm.common import table
from feedback_engine.operators.scan import placed

#: What stands between words: ASCII without digits and letters.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS, SEED, LEAST, PERCENT = 1, 10_000, 2024, 20, 10


def words(text: Column) -> Column:
    """The words of a text, in order; A to Z in small letters, other letters as they are."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), NO_WORD), lambda w: w != "")


def positions(docs: DataFrame, text: str = "text") -> DataFrame:
    """The position table: docs with pos, word instead of text, a row for each word; one with a null word for a text without any."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode_outer(words(F.col(text).cast("string"))).alias("pos", "word"))


def grams(table: DataFrame, orders: int = ORDERS, key: str = "r") -> DataFrame:
    """A position table's columns without pos and word, and k, gram: all runs of k + 1 consecutive words of a document, up to `orders`."""
    others = [c for c in table.columns if c not in ("pos", "word")]
    if orders == 1:
        return table.select(*others, F.lit(0).alias("k"), F.col("word").alias("gram"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = table.select(*others, "word", *[F.lead("word", k).over(w).alias(f"next{k}") for k in range(1, orders)])
    runs, each = [F.col("word")], F.col("word")
    for k in range(1, orders):
        each = F.concat(each, F.lit(" "), F.col(f"next{k}"))  # null behind the last word
        runs.append(each)
    return rows.select(*others, F.posexplode_outer(F.array_compact(F.array(*runs))).alias("k", "gram"))


def bucketed(grams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """grams with bucket instead of gram: the checksum of its bytes, modulo buckets; null for no gram."""
    others = [c for c in grams.columns if c != "gram"]
    return grams.select(*others, F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def counted(rows: DataFrame) -> DataFrame:
    """How many rows each bucket has."""
    return rows.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain from the counts (bucket, n) of both corpora: a row for each bucket that `own` has."""
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    both = own.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.crossJoin(F.broadcast(total(own, "all_s"))).crossJoin(F.broadcast(total(target, "all_t")))  # one row each
    plus = lambda c, n: (F.col(c) + n).cast("double")
    share = (F.coalesce("t", F.lit(0)) + 1).cast("double") * plus("all_s", buckets) / (plus("s", 1) * plus("all_t", buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def weighed(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs (doc_id, text) towards target (text)."""
    made = lambda df, *more: bucketed(grams(positions(df.select(F.monotonically_increasing_id().alias("r"), *more, "text")), orders), buckets)
    own = made(docs, "doc_id")
    gain = gains(counted(own), counted(made(target)), buckets)
    each = own.join(F.broadcast(gain), "bucket", "left")  # `buckets` rows at most
    unigrams = F.count(F.when(F.col("k") == 0, F.col("bucket")))
    # A document's rows stand together, so each task adds them up to one before they travel.
    sums = each.groupBy("r", "doc_id").agg(unigrams.alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return sums.drop("r")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text): of those with `least` words or more, percent of 100 are drawn and have a rank, from 1 by score."""
    out = weighed(docs, target, orders, buckets)
    out = out.withColumns({"score": (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"), "able": F.col("n_words") >= least})
    out = placed(out, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")])
    able = out.agg(F.count(F.when(F.col("able"), 1)).alias("n_able"))
    drawn = F.col("able") & (F.col("place") <= F.floor(F.col("n_able") * percent / F.lit(100)))
    return out.crossJoin(F.broadcast(able)).select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))  # one row


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts, and the rank of those that are drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum of each distinct word is folded over its bytes by the 256 entries that eight steps give each byte.
OP13_SQL = f"""WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS entries FROM step WHERE k = 8),
tok AS MATERIALIZED (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM documents
 UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) FROM benchmark),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM tok)),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a // 256, entries[xor(a, b) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket FROM spelt, crc),
feature AS MATERIALIZED (SELECT side, doc_id, bucket FROM tok JOIN hashed USING (word)),
bucket AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM feature GROUP BY bucket),
total AS (SELECT sum(s)::BIGINT AS S_, sum(t)::BIGINT AS T_ FROM bucket),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (S_ + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (T_ + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM bucket, total),
weight AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM feature JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN weight w ON d.doc_id = w.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST})
SELECT s.doc_id, n_features, weight, score, rank FROM scored s LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT {PERCENT} * count(*) // 100 FROM ranked)) r ON s.doc_id = r.doc_id"""
