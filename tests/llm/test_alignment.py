"""Alignment of two tokenizers against a plain computation with the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feedback_engine.llm import alignment as al
from feedback_engine.llm.tokens import byte_letters

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTER = {chr(v): k for k, v in byte_letters().items()}


def tokens(text):
    """(ids, bytes) of both sides; none if a side does not give the text back."""
    data = f" {text}".encode()
    a, b = A.encode(f" {text}", add_special_tokens=False), B.encode(text)
    a_bytes = [bytes(LETTER[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([B.id_to_piece(i) == f"<0x{n:02X}>" and n for n in range(256) if B.id_to_piece(i) == f"<0x{n:02X}>"]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return (list(a.ids), a_bytes, b, b_bytes) if b"".join(a_bytes) == data == b"".join(b_bytes) else None


def aligned(text):
    """n_a, n_b, groups, links of a text, token by token."""
    found = tokens(text) if text else None
    if found is None:
        return 0, 0, [], []
    a, a_bytes, b, b_bytes = found
    groups, links, own, other, left, right, j = [], [], [], [], 0, 0, 0
    for i, x in enumerate(a):
        left += len(a_bytes[i])
        own.append(x)
        while right < left:
            right += len(b_bytes[j])
            other.append(b[j])
            j += 1
        if left == right:
            groups.append((own, other))
            links.append((own[-1], other[-1]))
            own, other = [], []
    return len(a), len(b), groups, links


def brute(rows):
    each = [(i, *aligned(t)) for i, t in rows]
    count = Counter(link for *_, links in each for link in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, n_a, n_b, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(6)
    alphabet = "ab sS'tre  \n\té漢1٣!?🙂\x00<s>.,"
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 900]))) for _ in range(30)] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(200)]
    texts += ["", None, "▁", "a ▁b", "a b", "<|endoftext|> </s> <unk> <0x41>", "x" * 3000, "the the the", "the the the", texts[0]] + ["the"] * 150
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (None, "no id")]


def test_query(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, al.op12_token_alignment(spark, folder(documents=docs)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("heavy", [1, 3, 1 << 30])
def test_frequent_pairs_or_none(spark, rows, heavy):
    """Whether pairs are broadcast or cogrouped, their links count the same."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = al.written(al.aligned(docs, full=True), "aligned")
    got = al.link_scores(made, heavy).join(made, "r").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == [r for r in brute(rows) if r[3]]
    for r in made.collect():
        assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] or not r["n_groups"] and r["groups"] == ""


def test_hot_pair_is_not_shuffled_and_nothing_is_collected_by_it(spark):
    """A third of all postings are one pair, and each row of the others stays in its own task's share."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the' ELSE concat('w', id, ' of ', id % 7) END AS text")
    made = al.written(al.aligned(docs), "aligned")
    scores = al.link_scores(made)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert scores.count() == 3000


def test_odd_rows(spark, folder, odd_docs):
    got = al.op12_token_alignment(spark, folder(documents=odd_docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert al.op12_token_alignment(spark, folder(documents=odd_docs.limit(0))).count() == 0
