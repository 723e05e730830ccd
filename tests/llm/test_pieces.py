import functools
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from feedback_engine.llm import pieces
from feedback_engine.llm.tokens import vocabulary

PATH = vocabulary(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = pieces.encoder(PATH)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def in_chunks(text, size):
    s, m = ENCODER.shown(text), ENCODER.v.longest + 1
    chunks = []
    for i in range(-(-len(s) // size)):
        low, stop = max(0, i * size - m), min(len(s), (i + 1) * size)
        chunks.append((s[low : stop + m], i * size - low, stop - low))
    states = pieces.boundary_states([ENCODER.matrix(*c) for c in chunks])
    return b"".join(ENCODER.backtrace(*c, a, b) for c, a, b in zip(chunks, states, states[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab theing\n\t.,漢é🙂ß0123 erons"), max_size=80))
def test_same_as_the_library(text):
    assert ids(ENCODER.encode(text)) == LIBRARY.encode(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text
    if text:
        assert ids(in_chunks(text, 20)) == LIBRARY.encode(text)


def test_no_meeting_places():
    text = "a" * 300 + "theing" * 150
    assert ids(in_chunks(text, 100)) == LIBRARY.encode(text) == ids(ENCODER.encode(text))


def test_product_is_associative():
    rng = random.Random(3)
    states = [(1, 0), (2, 1), (1, 2)]
    a, b, c = ({(s, t): rng.randint(-9, 0) for s in states for t in states if rng.random() < 0.8} for _ in range(3))
    assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))


def test_giant_and_odd_rows(spark, odd_docs, words):
    giant = " ".join(words)
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, giant), (50, giant), (51, giant + " end")], "doc_id long, text string"))
    got = sorted((str(r["doc_id"]), ids(r["ids"])) for r in pieces.encoded(docs, giant=5000, chunk=3000).collect())
    assert got == sorted((str(r["doc_id"]), LIBRARY.encode(r["text"] or "")) for r in docs.collect())
    deep = docs.filter("doc_id >= 50").unionByName(spark.createDataFrame([(None, giant * 2)], "doc_id long, text string"))
    got = sorted((str(r["doc_id"]), ids(r["ids"])) for r in pieces.encoded(deep, giant=500, chunk=300, fan=4).collect())
    assert got == sorted((str(r["doc_id"]), LIBRARY.encode(r["text"])) for r in deep.collect())
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_states_by_halves():
    """Products of groups give the same states as the whole sequence."""
    text = "theing the abc " * 60 + "a" * 90
    s, m = ENCODER.shown(text), ENCODER.v.longest + 1
    cut = [(max(0, i - m), i, min(len(s), i + 50)) for i in range(0, len(s), 50)]
    matrices = [ENCODER.matrix(s[low : stop + m], i - low, stop - low) for low, i, stop in cut]
    whole = pieces.boundary_states(matrices)
    half = len(matrices) // 2
    tops = [pieces.reduce(pieces.product, part) for part in (matrices[:half], matrices[half:])]
    _, middle, end = pieces.boundary_states(tops)
    assert whole == pieces.boundary_states(matrices[:half], (0, 0), middle) + pieces.boundary_states(matrices[half:], middle, end)[1:]


def unigram():
    e = pieces.Encoder(open(PATH, "rb").read())
    e.v.kind = pieces.UNIGRAM
    return e


def weight(v, found):
    return sum(v.score[v.ids[p]] if p in v.ids else v.unknown_score for p in found)


def test_unigram_weights():
    """The same lattice with scores: the best total wins."""
    v = unigram().v
    for text in ("▁theing", "▁abcabc", "▁internationalization"):
        best = v.table(text, None)

        @functools.cache
        def brute(i, text=text):
            if i == len(text):
                return 0.0
            ends = [j for j in range(i + 1, len(text) + 1) if j == i + 1 or text[i:j] in v.ids]
            return max(weight(v, [text[i:j]]) + brute(j) for j in ends)

        assert best[len(text)][0] == pytest.approx(brute(0))
        assert weight(v, v.traced(text, best, len(text))) == pytest.approx(brute(0))


def test_unigram_in_chunks():
    """Chunks joined by transfer matrices weigh as much as the whole text."""
    e, rng = unigram(), random.Random(2)
    names = {i: t for t, i in e.v.ids.items()}
    for _ in range(40):
        s = e.shown("".join(rng.choice("abetinghos  ") for _ in range(rng.randint(30, 150))))
        m, size = e.v.longest + 1, rng.choice([7, 20, 64])
        cut = [(s[max(0, i - m) : i + size + m], min(i, m), min(i, m) + min(size, len(s) - i)) for i in range(0, len(s), size)]
        states = pieces.boundary_states([e.matrix(*c) for c in cut])
        found = [names[i] for c, a, b in zip(cut, states, states[1:], strict=False) for i in ids(e.backtrace(*c, a, b))]
        assert "".join(found) == s
        assert weight(e.v, found) == pytest.approx(e.v.table(s, None)[len(s)][0])
