"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and
character trigrams; a softmax over that average gives its quality. Vectors and
weights are trained together by stochastic gradient descent in numpy. A word
that repeats the one before it is one feature whatever the word, so repetition
can be learned.

Training takes a bounded sample: about `per_label` labelled documents of each
label, chosen by a hash of the id over all labels, each with its `kinds` most
frequent features at most (a sample of 4000 documents is then 256 MB at worst).
Since the softmax is linear
in the average, scoring needs one number for each bucket (1 MB, broadcast,
whatever the corpus) and is one scan without a shuffle.

Defined cases: null and empty texts have no features and score what the prior
says; null labels, and documents with contradictory labels, teach nothing; with
no labels every score is 0.5; repeated rows get the same result; whole texts
count, in blocks cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import fold, small_batches, table

WORDS, PAIRS, CHARS = 1 << 16, 1 << 16, 1 << 16
SIZE = WORDS + PAIRS + CHARS
BLOCK = 1 << 20
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64).astype(np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _block_features(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = ~_BLANK[b]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    if not len(starts):
        return np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(b)]))))
    word = np.add.reduceat(np.where(inside, _BYTE[b] * _PLACE[place & 63], np.uint64(0)), starts) * _MIX
    word ^= word >> np.uint64(31)
    pair = (word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:]) * _MIX
    pair = (pair >> np.uint64(48)).astype(np.int64)
    pair[word[1:] == word[:-1]] = 0
    out = [((word * _MIX) >> np.uint64(48)).astype(np.int64), WORDS + pair]
    if len(b) >= 3:
        c = b.astype(np.uint32)
        three = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(2246822519)
        out.append(WORDS + PAIRS + (three >> np.uint32(16)).astype(np.int64))
    return np.concatenate(out)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text's features, block by block."""
    raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(raw):
        end = at + BLOCK
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            end = cut if cut > at else end
        yield _block_features(raw[at:end])
        at = end


@dataclass
class Model:
    gain: np.ndarray  # for each bucket, its part in the log odds of label 1
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total, n = total + float(self.gain[f].sum(dtype=np.float64)), n + len(f)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -30, 30))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], shares: tuple[float, float], dims: int = 8, epochs: int = 12, rate: float = 4.0, seed: int = 11) -> Model:
    """A model from (label, buckets, counts); shares: of the labels among all learned documents."""
    if not rows:
        return Model(np.zeros(SIZE, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((SIZE, dims), np.float32) - 0.5) / dims).astype(np.float32)
    softmax, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, n = rows[i]
            lr, steps = rate * (1 - steps / total), steps + 1
            if not len(at):
                continue
            weight = (n / n.sum()).astype(np.float32)
            own = vectors[at]
            mean = weight @ own
            z = mean @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # the gradient by z
            back = softmax @ p
            softmax -= np.float32(0.1 * lr) * np.outer(mean, p)
            bias -= np.float32(0.01 * lr) * p
            vectors[at] = own - np.float32(lr) * np.outer(weight, back)
    seen = [sum(r[0] == k for r in rows) for k in (0, 1)]
    prior = float(np.log((shares[1] + 1e-9) / (shares[0] + 1e-9)) - np.log((seen[1] + 1e-9) / (seen[0] + 1e-9)))
    return Model(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]) + prior)


def learned(docs: DataFrame, labels: DataFrame, per_label: int = 2000, kinds: int = 8192) -> Model:
    """Fit on about per_label documents of each label; docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    labels = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    n = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return fit([], (0.5, 0.5))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labels.filter(unit < F.when(F.col("label") == 1, per_label / n.get(1, 1)).otherwise(per_label / n.get(0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                f = np.zeros(SIZE, np.int64)
                for x in features(text):
                    f += np.bincount(x, minlength=SIZE)
                at = np.flatnonzero(f)
                at = np.sort(at[np.argsort(-f[at], kind="stable")[:kinds]])
                rows.append((label, at.astype(np.int32).tobytes(), f[at].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["label", "at", "n"])

    # The sample is bounded by per_label, so its ids can be sent to every executor.
    chosen = docs.join(F.broadcast(sample), "doc_id").select(F.col("text").cast("string"), F.col("label").cast("int"))
    got = chosen.mapInArrow(run, "label int, at binary, n binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["n"])))
    total = sum(n.values())
    return fit([(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in got], (n.get(0, 0) / total, n.get(1, 0) / total))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from those whose id's remainder is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    rows = scored(docs, learned(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
