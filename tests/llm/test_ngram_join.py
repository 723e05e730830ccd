import random

import duckdb
import pytest

from feedback_engine.llm import ngram_join as n


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(25)]
    texts = []
    for b in base:
        texts += [" ".join(b)] * 2 + [" ".join(edited(rng, b, k)) for k in (1, 2, 3, 4, 6)]
    hot = [f"h{i}" for i in range(200)]
    texts += [" ".join(edited(rng, hot, 1)) for _ in range(120)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(90)) + " " + shared for _ in range(80)]
    texts += ["", None, "  ", "one", "one", "two words", "a b c d e", "a b c d e"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_sql(spark, docs, folder):
    d = folder(documents=docs)
    want = sorted(map(tuple, duckdb.sql(n.OP3_SQL.replace("FROM documents", f"FROM read_parquet('{d}/documents.parquet/*.parquet')")).fetchall()), key=str)
    assert sorted(map(tuple, n.op3_ngram_join(spark, d).collect()), key=str) == want
    # Small buckets, blocks and parts: every way of dealing gives the same.
    small = n.joined(docs, bucket=4, block=16, block_bytes=1 << 14, part=8).select("doc_id", "class_id", "n_links")
    assert sorted(map(tuple, small.collect()), key=str) == want


def test_one_of_each(spark, docs, odd_docs):
    found = {r["doc_id"]: r["class_id"] for r in n.joined(docs).collect()}
    assert sorted(r["doc_id"] for r in n.one_of_each(docs).collect()) == sorted({c for c in found.values()})
    kept = n.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "None", "5", "7", "8", "9"])
    assert n.one_of_each(odd_docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in n.components(spark.createDataFrame(links, "a long, b long").filter("a <> b")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_runs_grow_with_recall():
    assert n.runs_for(0.9) < n.runs_for(0.999) < n.runs_for(0.999999)


def test_short_near_copies(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(9, 20) if i % 10 else rng.randint(45, 95))]
        rows += [(3 * i, base), (3 * i + 1, base[:-1]), (3 * i + 2, [*base[:-1], "other"])]
    grams = {d: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for d, w in rows}
    links = {d: [o for o in range(d - d % 3, d - d % 3 + 3) if o != d and 5 * len(grams[d] & grams[o]) >= 4 * len(grams[d] | grams[o])] for d in grams}
    want = {d: (min([d, *x, *(y for o in x for y in links[o])]), len(x)) for d, x in links.items()}
    got = n.joined(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want


@pytest.mark.parametrize("size", [5, 50, 64, 77, 81, 200])
def test_outlines_of_similar_sets_meet(size):
    rng = n.np.random.default_rng(size)
    for _ in range(300):
        a = rng.integers(1, 1 << 63, size).astype(n.np.uint64)
        sets = [a, a[: -(-size * 4 // 5)]]
        assert n.leader_links([0, 1], [n.outline(x, 0.8) for x in sets], 0.9, 0.45, 0.68)[0] == [(1, 0)]


def test_runs_hold_for_a_set_within_another():
    alive = 1.0
    for growth in reversed(n.GROWTH):
        alive = 1 - n.math.exp(-growth * 0.8 * alive)
    for recall in (0.9, 0.99, 0.999, 0.9999):
        assert (1 - alive) ** n.runs_for(recall) <= 1 - recall


def test_components_with_a_star(spark):
    """A centre with 100 000 edges that is not the smallest node, a chain, and rings; no task gets the centre's edges alone."""
    from pyspark.sql import functions as F

    star = spark.range(100_000).select((F.col("id") + 1_000_000).alias("a"), F.lit(500_000).cast("long").alias("b"))
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    ring = spark.range(30).select((F.col("id") % 10 + F.floor(F.col("id") / 10) * 10 + 100).alias("a"), ((F.col("id") + 1) % 10 + F.floor(F.col("id") / 10) * 10 + 100).alias("b"))
    got = n.components(star.unionByName(chain).unionByName(ring))
    sizes = {r["label"]: (r["n"], r["m"]) for r in got.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("m")).collect()}
    assert sizes == {500_000: (100_001, 500_000), 0: (41, 0), 100: (10, 100), 110: (10, 110), 120: (10, 120)}
