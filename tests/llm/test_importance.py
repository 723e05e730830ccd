"""Importance resampling against the definition in plain Python, and against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from feedback_engine.llm import importance as im

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, orders):
    words = WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, seed=2024, orders=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f) % buckets
    own = [(i, *features(t, orders)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, orders)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.fixture(scope="module")
def corpus(words):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 19, 20, 21, 80, 400]))) for _ in range(150)]
    texts += [None, "", "  \n", "ÄÖÜ Straße ÉTÉ 漢字 x2 Ⅷ ǅ" * 5, "A-B_C`d{e\x7ff\x00g 0:9 Z[ " * 8, "one " * 3000]
    docs = list(enumerate(texts)) + [(5, texts[5]), (None, texts[9]), (None, texts[9]), (7, "another text under one id " * 9)]
    return docs, [t for t in texts[:12]] + [None, "", "Öl und ÉTÉ"]


@pytest.mark.parametrize(("orders", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (2, 10_000, 33, 5), (3, 7, 100, 0), (4, 10_000, 0, 1)])
def test_against_the_definition(spark, corpus, orders, buckets, percent, least):
    docs, target = corpus
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = im.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, orders=orders, buckets=buckets)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, target, percent, least, orders=orders, buckets=buckets)


def test_query_against_its_sql(spark, folder, corpus):
    docs = spark.createDataFrame([(i, t, i) for i, t in dict(corpus[0]).items() if i is not None], "doc_id long, text string, rank long")
    path = folder(documents=docs, benchmark=spark.createDataFrame([(t, 1) for t in corpus[1]], "text string, item_id long"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({im.OP13_SQL})").fetchall()
    assert sorted(map(tuple, im.op13_importance_resampling(spark, path).collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark, folder, odd_docs):
    target = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = im.op13_importance_resampling(spark, folder(documents=odd_docs, benchmark=target)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], ["one two three"])
    for docs, bench in ((odd_docs.limit(0), target), (odd_docs, target.limit(0)), (odd_docs.limit(0), target.limit(0))):
        assert im.op13_importance_resampling(spark, folder(documents=docs, benchmark=bench)).count() == docs.count()


def test_equal_scores_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l m n o p q r s t u") for i in (5, 5, 5, 3, None, None)] * 5, "doc_id long, text string")
    got = im.resampled(docs, docs.select("text"), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 31))
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["score"] for r in got), reverse=True)
