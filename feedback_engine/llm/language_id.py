"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams of its lower-case letters, weighted by
TF-IDF and normalised. Each learned language has several centroids from
spherical k-means; the nearest one by cosine names the language, and a text too
far from all of its language's centroids is rejected. How far is too far is
judged by learned texts that the k-means did not see: a share of each language's
sample is held out, and the limit is `slack` of the cosine that all but a
`quantile` of them reach.

The model is fitted on a bounded sample: at most about `per_lang` learned
documents of each language and `sample` of all, chosen by a hash of their ids over
the whole table (languages are expected in hundreds), each with its `kinds` most
frequent n-grams at most. Prediction is one scan without a shuffle;
the model broadcast is buckets x centroids floats, whatever the corpus.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
rejected; rows with a null lang or id teach nothing; if nothing can be learned
every text is `und`; repeated rows get the same result; whole texts count;
a letter is a character of Unicode category L, so "½" or "²" is none; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine.llm.common import fold, small_batches, table

BUCKETS_LOG2 = 13
ORDERS = (2, 3)
BLOCK = 1 << 20
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)
#: ASCII other than letters becomes a blank; bytes of other scripts stay.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_FACTORS = {2: np.uint32(2654435761), 3: np.uint32(2246822519)}


def counts(text: str) -> np.ndarray:
    """How often each n-gram bucket occurs in a whole text."""
    out = np.zeros(1 << BUCKETS_LOG2, np.int64)
    words = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    raw = b" ".join([b"", *words, b""]) if words else b""
    for order in ORDERS:
        for at in range(0, len(raw) - order + 1, BLOCK):  # by where an n-gram starts
            b = np.frombuffer(raw, np.uint8, min(BLOCK + order - 1, len(raw) - at), at).astype(np.uint32)
            codes = b[: len(b) - order + 1]
            for j in range(1, order):
                codes = codes << np.uint32(8) | b[j : len(b) - order + 1 + j]
            out += np.bincount((codes * _FACTORS[order]) >> np.uint32(32 - BUCKETS_LOG2), minlength=len(out))
    return out


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    weighted: np.ndarray  # buckets x centroids: idf times unit centroid
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text of each language is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine with its nearest centroid, rejected)."""
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        tf = np.log1p(counts(text).astype(np.float32))
        norm = float(np.sqrt(((tf * self.idf) ** 2).sum()))
        if norm == 0:
            return "und", 0.0, True
        near = tf @ self.weighted / norm
        best = int(near.argmax())
        lang, score = self.owner[best], min(1.0, max(0.0, float(near[best])))
        return self.languages[lang], score, score < self.least[lang]


def _clusters(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):  # the row farthest from all centroids is the next
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centers = x[chosen].copy()
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        for j in range(len(centers)):
            own = x[near == j]
            if len(own):
                center = own.sum(0)
                centers[j] = center / max(float(np.linalg.norm(center)), 1e-12)
    return centers


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], centroids: int = 3, rounds: int = 10, quantile: float = 0.01, slack: float = 0.7, unseen: int = 5) -> Model:
    """A model from (language, buckets, counts) of learned documents; every `unseen`-th of a language that has twice as many only judges distances."""
    size = 1 << BUCKETS_LOG2
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    df = np.zeros(size)
    for _, at, _ in rows:
        df[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    owner, centers, least = [], [], []
    for i, lang in enumerate(languages):
        own = [r for r in rows if r[0] == lang]
        x = np.zeros((len(own), size), np.float32)
        for j, (_, at, n) in enumerate(own):
            x[j, at] = np.log1p(n)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        judges = np.arange(len(x)) % unseen == unseen - 1 if len(x) >= 2 * unseen else np.zeros(len(x), bool)
        found = _clusters(x[~judges], centroids, rounds, i)
        least.append(slack * float(np.quantile((x[judges if judges.any() else ~judges] @ found.T).max(1), quantile)))
        centers.append(found)
        owner += [i] * len(found)
    weighted = (np.concatenate(centers).T * idf[:, None]).astype(np.float32) if centers else np.zeros((size, 0), np.float32)
    return Model(languages, np.array(owner, int), weighted, idf, np.array(least))


def learned(docs: DataFrame, text: Column, lang: Column, per_lang: int = 800, languages: int = 1000, sample: int = 20_000, kinds: int = 4096) -> Model:
    """Fit on about per_lang rows of docs (with doc_id) of each language at most, about `sample` in all, and on `kinds` n-grams of each row at most. More than `languages` values of lang are an error: their centroids would not fit the driver, and none is left out in silence."""
    rows = docs.select(F.col("doc_id"), text.cast("string").alias("text"), lang.cast("string").alias("lang")).filter("doc_id is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1)
    shares = {r["lang"]: r["n"] for r in sizes.collect()}
    if len(shares) > languages:
        raise ValueError(f"lang has more than {languages} values; merge them (regional tags, dirty labels) or give a larger `languages`")
    if not shares:
        return fit([])
    per_lang = min(per_lang, sample // len(shares))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.create_map(*[F.lit(x) for k, n in sorted(shares.items()) for x in (k, per_lang / n)])
    chosen = rows.filter(unit < F.element_at(limit, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ats, ns = [], [], []
            for text, lang in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                n = counts(text or "")
                at = np.flatnonzero(n)
                at = np.sort(at[np.argsort(-n[at], kind="stable")[:kinds]])
                langs.append(lang)
                ats.append(at.astype(np.uint16).tobytes())
                ns.append(n[at].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], names=["lang", "at", "n"])

    got = chosen.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    return fit([(r["lang"], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.int32)) for r in got])


def predicted(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`row`, a struct of docs' columns (those to keep), and `found`: lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see above
    result = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.predict(x.as_py()) for x in batch.column(1)]
            found = pa.array([{"lang_pred": a, "score": b, "rejected": bool(c)} for a, b, c in out], result)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "found"])

    schema = own.select("row").schema.add("found", T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType()))
    return own.mapInArrow(run, schema)


def known_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those whose language is rejected, with their columns; learned from their own text and lang. If nothing can be learned, no distance is known, and only texts without a letter go."""
    model = learned(docs.filter(fold(F.col("doc_id"), 3) != 1), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`"))
    if not model.languages:
        return docs.filter(F.col(f"`{text_col}`").cast("string").rlike(LETTER))
    return predicted(docs, model, text_col).filter("not found.rejected").select("row.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.filter(fold(F.col("doc_id"), 3) != 1), F.col("text"), F.col("lang"))
    rows = predicted(docs, model, keep=["doc_id"]).select("row.doc_id", "found")
    return rows.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")
