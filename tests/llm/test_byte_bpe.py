"""Byte-level encoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedback_engine.llm import byte_bpe as b

RANKS = b.read_ranks(public_tokenizers.path(b.RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = b.coder()
ALPHABET = "abrevlmstdSTLL'''  \n\t\r 　\x1c\x85é漢ل1٣²!?’-🙂\x00힣"


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=30), max_size=5))
def test_ids_are_the_librarys(texts):
    got = CODER.encode(texts)
    assert [ids(x) for x in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODER.decode(x, CODER.offsets(x)) for x in got] == [t.encode() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(CODER.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_slices_are_the_patterns():
    """Slices alone, against a regular expression, in texts long enough for several levels of blocks."""
    rng = random.Random(2)
    for size in (10, 63, 64, 65, 4096, 4097, 20_000):
        text = "".join(rng.choice("abrevlst'' \n\té1!") for _ in range(size))
        pieces, marks = CODER.sliced([text, "", text[:7]])
        want = [regex.findall(public_tokenizers.PATTERN, t) for t in (text, "", text[:7])]
        assert [x.decode() for x in pieces[: marks[0]]] == want[0] and [x.decode() for x in pieces[marks[1] + 1 : marks[2]]] == want[2]


def test_composition_is_associative():
    """However the classes are cut, the functions of the parts compose to that of the whole."""
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, b.END + 1, 500).astype(np.uint8)

    def function(part):
        f = b.IDENTITY.copy()
        for k in part:
            f = b.stepped(np.array([k], np.uint8), f)
        return f

    whole = function(kinds)
    for cuts in ([100], [1, 2, 250], [499]):
        out = b.IDENTITY
        for part in np.split(kinds, cuts):
            out = function(part)[out]
        assert (out[: b.SPACE_N + 1] == whole[: b.SPACE_N + 1]).all()
    functions = np.stack([function([k]) for k in kinds])
    at, want = b.START, []
    for f in functions:
        want.append(at)
        at = int(f[at])
    assert b.entered(functions).tolist() == want


def test_every_code_point():
    """Each code point among letters, digits, signs and blanks encodes as in the library."""
    rng = random.Random(1)
    points = [c for c in [*range(0x3000), *rng.sample(range(0x3000, 0x110000), 20_000)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}  {chr(c)}" for c in points]
    for low in range(0, len(texts), 5000):
        part = texts[low : low + 5000]
        assert [ids(x) for x in CODER.encode(part)] == [LIBRARY.encode_ordinary(t) for t in part]


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 3000, "é" * 2000, "xqz" * 700, "\n" * 3000, " " * 4000, "!?" * 900, "​" * 500, "aé" * 60])
def test_long_slices(piece):
    for text in (piece, f"x {piece} y", piece[:99], piece[:101]):
        assert ids(CODER.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_giants_are_cut_where_it_does_no_harm():
    rng = random.Random(4)
    text = "".join(rng.choice(ALPHABET) for _ in range(3000))
    for most in (50, 333, 2999):
        assert CODER.encode([text, "x", text[:60]], most) == [np.array(LIBRARY.encode_ordinary(t), "<u4").tobytes() for t in (text, "x", text[:60])]
        assert "".join(b.cut(text, most)) == text


def test_runs_of_a_document_decode_by_their_offsets():
    text = "Some text — 漢字 and more of it"
    data = CODER.encode([text])[0]
    offsets = CODER.offsets(data)
    at = ids(offsets)
    for i in range(len(at)):
        for j in range(i + 1, len(at) + 1):
            end = at[j] if j < len(at) else len(text.encode())
            assert CODER.decode(data[4 * i : 4 * j], offsets[4 * i : 4 * j]) == text.encode()[at[i] : end]


def test_query(spark, folder, odd_docs):
    got = b.op11_byte_bpe(spark, folder(documents=odd_docs)).collect()

    def want(text):
        found = LIBRARY.encode_ordinary(text or "")
        return len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=r["doc_id"], n_tokens=n, ids_sha256=i, decoded_sha256=d)) for r in odd_docs.collect() for n, i, d in [want(r["text"])])
    assert b.op11_byte_bpe(spark, folder(documents=odd_docs.limit(0))).count() == 0
    other = odd_docs.select("text", odd_docs["doc_id"].cast("string").alias("doc_id"), odd_docs["doc_id"].alias("ids"), odd_docs["doc_id"].alias("offsets"))
    assert dict(b.encoded(other).dtypes) == {"doc_id": "string", "ids": "binary", "offsets": "binary"} and b.encoded(other).count() == odd_docs.count()
