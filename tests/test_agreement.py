"""Several models' tags of the same records."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from feedback_engine import enrich
from feedback_engine.operators import agreement

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fake models travel to the workers
TAGS = ["a", "b", "c", "d", "e"]
#: How often each fake model gives a tag that holds, and one that doesn't.
MODELS = {"good": (0.95, 0.02), "fair": (0.8, 0.08), "poor": (0.55, 0.3)}


def truth(i):
    rng = random.Random(i)
    return [t for t in TAGS if rng.random() < 0.3]


def fake(name):
    def model(texts):
        out = []
        for x in texts:
            i = int(x.split()[1])
            rng = random.Random(f"{name} {i}")
            out.append([t for t in TAGS if rng.random() < MODELS[name][0 if t in truth(i) else 1]] + (["unknown"] if i % 50 == 0 else []))
        return out

    return model


@pytest.fixture(scope="module")
def labels(spark):
    records = spark.range(1500).select("id", F.concat(F.lit("record "), F.col("id").cast("string")).alias("text"))
    out = None
    for name in MODELS:
        # The poor model leaves a tenth of the records out.
        rows = enrich.by_model(records.filter("id % 10 <> 3") if name == "poor" else records, fake(name), "id", TAGS).select(F.lit(name).alias("model"), F.col("id").alias("key"), "tags")
        out = rows if out is None else out.unionByName(rows)
    return out.persist()


def test_rates_from_votes_alone(labels):
    found, rates = agreement.consensus(labels, list(MODELS), TAGS)
    for r in rates.collect():
        hit, false = MODELS[r["model"]]
        assert abs(r["hit_rate"] - hit) < 0.06 and abs(r["false_rate"] - false) < 0.06
    got = {r["key"]: set(r["tags"]) for r in found.collect()}
    assert len(got) == 1500
    wrong = lambda answers: sum(len(set(tags) ^ set(truth(k))) for k, tags in answers.items())
    alone = {m: {r["key"]: r["tags"] for r in labels.filter(F.col("model") == m).collect()} for m in MODELS}
    majority = {k: [t for t in TAGS if sum(t in alone[m].get(k, []) for m in MODELS) >= 2] for k in got}
    assert wrong(got) <= min(wrong(alone["good"]), wrong(majority)) and wrong(got) < wrong(alone["fair"])


def test_pairs(labels):
    got = {(r["model_a"], r["model_b"]): r for r in agreement.pairwise(labels).collect()}
    assert got.keys() == {("fair", "good"), ("fair", "poor"), ("good", "poor")}
    rows = {m: {r["key"]: set(r["tags"]) for r in labels.filter(F.col("model") == m).collect()} for m in MODELS}
    for (a, b), r in got.items():
        keys = rows[a].keys() & rows[b].keys()
        assert r["n"] == len(keys) and r["same"] == sum(rows[a][k] == rows[b][k] for k in keys)
        shares = [len(rows[a][k] & rows[b][k]) / len(rows[a][k] | rows[b][k]) if rows[a][k] | rows[b][k] else 1 for k in keys]
        assert abs(r["overlap"] - sum(shares) / len(shares)) < 1e-3
    assert got["fair", "good"]["overlap"] > got["fair", "poor"]["overlap"]


def test_few_answers(spark):
    rows = [("x", 1, ["a"]), ("x", 2, []), ("x", 3, None), ("y", 1, ["a", "a", "zzz"]), ("other", 1, ["b"])]
    labels = spark.createDataFrame(rows, "model string, key long, tags array<string>")
    found, rates = agreement.consensus(labels, ["x", "y"], ["a", "b"])
    assert {r["key"]: r["tags"] for r in found.collect()} == {1: ["a"], 2: [], 3: []} and rates.count() == 2
    nothing = agreement.consensus(labels.limit(0), ["x"], ["a"])
    assert nothing[0].count() == 0 and nothing[1].count() == 1 and agreement.pairwise(labels.limit(0)).count() == 0
    with pytest.raises(ValueError):
        agreement.votes(labels, [str(i) for i in range(11)])
