"""Tokenisation, the store, and packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from feedback_engine.llm import packing, store, tokens

LIBRARY = Tokenizer.from_file(tokens.vocabulary())
ENCODE = tokens.encoder()


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abXYZ'stÀßµªº²é́ \n\t\u0085\x1c漢ΣςİK~!.,;<|endoftext|>019_-$%🙂"), max_size=40))
def test_words_give_the_same_ids(text):
    for t in (text, text + "<|endoftext|>", "<|ENDOFTEXT|> I'LL " + text):
        assert np.frombuffer(ENCODE(t), "<u4").tolist() == library(t)[:-1]


def test_checksums_combine():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(1, 300)), rng.randbytes(rng.randrange(1, 300))
        assert store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cuts_follow_content():
    ids = np.random.default_rng(0).integers(0, 49000, 20000)
    ends = store.cuts(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= store.MOST for a, b in zip([0, *ends], ends, strict=False))
    later = store.cuts(np.concatenate([np.arange(77), ids]))
    assert len({len(ids) - e for e in ends} & {len(ids) + 77 - e for e in later}) >= len(ends) - 3


@pytest.fixture(scope="module")
def documents(spark, words):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 700, 3000]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:20])] + [(1000, None), (1001, ""), (7, texts[7]), (None, "no id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_store_round_trip(spark, documents, tmp_path):
    rows, df = documents
    folder = str(tmp_path / "store")
    store.write_store(df, folder, part_docs=25)
    store.verified(spark, folder)
    want = sorted((str(i), library(t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in store.read_documents(spark, folder).collect()) == want
    got = sorted(store.read_store(spark, folder).collect(), key=lambda r: r["start"])
    by_id: dict = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(library(t))
    start = 0
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda x: -1 if x is None else x)
    for r in got:
        ids = by_id[r["doc_id"]][0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_damage_is_found(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "store")
    store.write_store(documents[1], folder)
    chunks = spark.read.parquet(f"{folder}/chunks").withColumn("payload", F.concat(F.substring("payload", 1, 2), F.substring("payload", 1, 2)))
    chunks.write.parquet(f"{folder}/other")
    spark.read.parquet(f"{folder}/other").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(PythonException):
        store.read_store(spark, folder).collect()


def test_empty_store(spark, tmp_path):
    store.write_store(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "s"))
    assert store.read_store(spark, str(tmp_path / "s")).count() == 0


def test_packing(spark, documents):
    rows, df = documents
    made = packing.packed(packing.pieces(df, capacity=512), capacity=512, partition_rows=40).collect()
    pool: dict = {}
    for i, t in rows:
        pool.setdefault(i, []).append(library(t))
    total = sum(len(x) for v in pool.values() for x in v)
    assert sum(r["length"] for r in made) == total
    bins: dict = {}
    for r in made:
        ids = pool[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 512 * r["piece"] and len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    lengths = np.bincount([r["length"] for r in made], minlength=513)
    assert len(bins) <= packing.lower_bound(lengths, 512) + 2


def test_bounds_hold_and_certify():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        where, offset, left = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(left)
        used = np.bincount(where, lengths)
        assert used.max() <= 100 and (100 - used == left).all()
    assert packing.lower_bound(np.bincount([60] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 7, minlength=101), 100) == 4


def test_odd_rows(spark, odd_docs):
    made = packing.packed(packing.pieces(odd_docs))
    assert made.select("doc_id", "piece").count() >= odd_docs.count()
    assert packing.packed(packing.pieces(odd_docs.limit(0))).count() == 0


def test_equal_rows_are_divided(spark, tmp_path):
    """A third of empty texts and 6000 equal rows without an id: parts stay of a size and all is read back."""
    from pyspark.sql import functions as F

    folder = str(tmp_path / "store")
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words here").alias("text"))
    rows = rows.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("").alias("text")))
    store.write_store(rows, folder, part_docs=1000)
    store.verified(spark, folder)
    sizes = [r["n_docs"] for r in store.recipes_of(spark, folder)[1].collect()]
    assert sum(sizes) == 9000 and max(sizes) < 2500
    got = store.read_store(spark, folder).collect()
    crc = lambda t: (len(library(t)), zlib.crc32(np.array(library(t), "<u4").tobytes()))
    want = {t: crc(t) for t in ["same words here", ""]}
    assert len(got) == 9000 and sum(r["doc_id"] is None for r in got) == 6000
    assert all((r["n_tokens"], r["ids_crc32"]) == (want["same words here"] if r["doc_id"] is None else want[""] if r["doc_id"] % 3 == 0 else crc(f"text {r['doc_id']}")) for r in got)
    assert sorted(r["start"] for r in got)[0] == 0 and len({r["start"] for r in got}) == 9000


def test_a_lost_part_is_seen(spark, documents, tmp_path):
    folder = str(tmp_path / "store")
    store.write_store(documents[1], folder, part_docs=20)
    files = spark.read.parquet(f"{folder}/recipes").filter("part <> 1")
    files.write.partitionBy("kind").parquet(f"{folder}/less")
    spark.read.parquet(f"{folder}/less").write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/recipes")
    with pytest.raises(ValueError, match="top"):
        store.verified(spark, folder)


def test_documents_rebuilt_from_files(spark, tmp_path):
    """Every document of the supplied table, from its recipe and chunks, against the library."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    folder = str(tmp_path / "store")
    store.write_store(docs, folder)
    got = {r["doc_id"]: list(r["ids"]) for r in store.read_documents(spark, folder).collect()}
    sums = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in store.read_store(spark, folder).collect()}
    for r in docs.collect():
        ids = library(r["text"])
        assert got[r["doc_id"]] == ids and sums[r["doc_id"]] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
