import random
import re
from collections import Counter

import duckdb

from feedback_engine.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def corpus(words):
    rng = random.Random(1)
    out = []
    for i in range(160):
        w = [rng.choice(words) for _ in range(120)]
        text = "\n".join(" ".join(w[k : k + 12]).capitalize() + "." for k in range(0, 120, 12))
        if i % 8 == 1:
            text = " ".join(x + "$$$" for x in text.split())
        if i % 8 == 2:
            text = " ".join(x.upper() + "!!" for x in text.split())
        if i % 8 == 3:
            text = " ".join([w[0]] * 60 + [w[1]] * 60)
        out.append((i, text))
    return out


def test_measures_against_brute_force(spark, odd_docs, words):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in corpus(words)] + [(99, "a b c a b c\n\x0bx y \na b c")], "doc_id long, text string"))
    for r in q.measured(docs).collect():
        m = r["m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == measures(r["row"]["text"]), r["row"]["doc_id"]


def test_junk_goes_and_prose_stays(spark, folder, words):
    rows = corpus(words)
    d = folder(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in q.op1_quality_rules(spark, d).collect()}
    assert all(got[i]["kept"] == (i % 8 not in (1, 2, 3)) for i, _ in rows)
    want = duckdb.sql(q.OP1_SQL.replace("FROM documents", f"FROM read_parquet('{d}/documents.parquet/*.parquet')")).fetchall()
    assert sorted(want) == sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], r["posterior"]) for r in got.values())


def test_odd_rows_and_empty_table(spark, odd_docs):
    clashing = odd_docs.withColumns({c: odd_docs["doc_id"] for c in ("m", "v", "_text", "_words", "_lines", "_three", "_sorted", "a.b")})
    kept = q.good_documents(clashing)
    assert kept.columns == clashing.columns and kept.count() == 0
    assert q.good_documents(odd_docs.limit(0)).count() == 0


def test_accuracies_follow_the_votes():
    good = sum(2 * 3**j for j, (_, _, g) in enumerate(q.RULES) if g != "false")
    bad = 1 + 3 * 1
    posterior, accuracy = q.fitted({good: 900, bad: 100})
    assert posterior[good] > 0.9 > 0.1 > posterior[bad]
    assert accuracy[0] > 0.9
