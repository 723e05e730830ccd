import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from feedback_engine.llm import repeats as r


def brute(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + least, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                covered[i : i + least] = True
        covered = covered[: len(t)]
        kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
        out.append((len(t), int(covered.sum()), int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefg hé") for _ in range(n))
    passage, other = noise(1500), noise(700)
    out = [noise(rng.randrange(1500)) for _ in range(20)]
    out += [noise(rng.randrange(600)) + passage[rng.randrange(300) : 1500 - rng.randrange(300)] + noise(rng.randrange(600)) for _ in range(60)]
    out += [other, other, other[:500], noise(3000) * 2, "ab" * 700, "", None, noise(399), passage + noise(50) + passage]
    return out


def test_against_brute_force(spark, texts, folder):
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1] + "x"), (-1, texts[25]), (-1, "y" + texts[2]), (None, texts[25]), (None, None)]
    d = folder(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute([(t or "").encode() for _, t in rows], r.LEAST)
    got = r.op4_repeated_substrings(spark, d).collect()
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def test_counting_path_gives_the_same(spark, texts):
    docs = r.hashed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    held, marks = r.spans(docs, most=1)
    want = brute([(t or "").encode() for t in texts], r.LEAST)
    for row in held.join(marks, ["id", "h"], "left").collect():
        kept, runs = r.remaining(row["text"].encode(), row["spans"])
        assert (len(runs), hashlib.sha256(kept).hexdigest()) == want[row["doc_id"]][2:]


def test_intervals_have_all_occurrences():
    texts = [b"xxabcdeyy", b"zzabcdeww", b"qqabcdq", b"abcd"]
    sa, lcp, owner, start = r.suffix_array(texts, [len(t) for t in texts])
    raw, base = b"".join(texts), np.cumsum([0] + [len(t) for t in texts])
    left = np.array([raw[base[o] + s - 1] if s else -1 - i for i, (o, s) in enumerate(zip(owner, start, strict=True))])
    found = {(d, frozenset((int(owner[i]), int(start[i])) for i in range(a, b + 1))) for d, a, b, _ in r.intervals(lcp, left, 4)}
    assert found == {(5, frozenset({(0, 2), (1, 2)})), (4, frozenset({(0, 2), (1, 2), (2, 2), (3, 0)}))}


def test_without_repeats(spark, odd_docs, texts):
    out = r.without_repeats(odd_docs, r.LEAST)
    assert out.columns == odd_docs.columns
    got = sorted((str(x["doc_id"]), str(x["text"])) for x in out.collect())
    want = sorted((str(x["doc_id"]), "word " * 0 if x["doc_id"] == 7 else str(x["text"])) for x in odd_docs.collect())
    assert got == want
    assert r.without_repeats(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [51, 60, 80])
def test_passages_of_over_fifty_words_go(spark, words):
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 5, 6, 8])))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(words), prose(30)
    texts = [prose(90) + " " + passage + " " + prose(90) for _ in range(5)] + [prose(60) + " " + short + " " + prose(60) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in r.without_repeats(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i] == t) == (i >= 5)
        assert i >= 5 or passage[2:-2] not in got[i] and got[i].startswith(t[:200]) and got[i].endswith(t[-200:])


def test_hot_keys_are_dealt(spark):
    from feedback_engine.llm.common import met

    big = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN 8 ELSE id END AS k", "id AS x")
    small = big.groupBy("k").count().withColumnRenamed("count", "n").filter("k <> 8").selectExpr("k", "n", "k * 2 AS y")
    total = big.count()
    assert met(big, small, "k", "n", total).selectExpr("sum(y)", "count(*)", "count(distinct x)").first() == big.filter("k <> 8").selectExpr("sum(k * 2)", "count(*)", "count(distinct x)").first()
    assert met(big, small, "k", "n", total, "left").selectExpr("count(*)", "count(y)").first() == (30_000, 19_999)  # 8 itself is in no row of small


def test_copies_share_one_list(spark):
    """Many rows with one id and text, and with none: what is held of them does not grow with their number."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    one = spark.createDataFrame([(7, text), (None, text[:900]), (8, text[300:800] + " own end")], "doc_id long, text string")
    sizes = {}
    for n in (3, 10_000):
        docs = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.coalesce("doc_id", F.lit(0)) == 8, 1).otherwise(n)))).drop("copy")
        held, marks = r.spans(r.hashed(docs))
        assert held.count() == 2 * n + 1 and marks.count() == 3
        sizes[n] = sorted(x[0] for x in marks.select(F.size("spans")).collect())
    assert sizes[10_000] == sizes[3] and max(sizes[3]) < 400


def test_passages_are_judged_by_words(spark):
    """51 short words go, also below the 250 bytes of long ones; 40 long words stay, and so do addresses and ids without blanks."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    short = " ".join(word(3) for _ in range(52))
    few = " ".join(word(9) for _ in range(40))
    address = word(300)
    cjk = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(400))
    own = lambda: " ".join(word(5) for _ in range(60))
    rows = [(i, f"{own()}\n{p}\n{own()}") for i, p in enumerate([short, short, few, few, address, address, cjk, cjk])] + [(8, own())]
    got = {x["doc_id"]: x["text"] for x in r.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, p in enumerate([short, short, few, few, address, address, cjk, cjk]):
        assert (p[10:-10] in got[i]) == (2 <= i < 6)
        assert rows[i][1][:300] in got[i] and rows[i][1][-300:] in got[i]
    assert got[8] == rows[8][1]
