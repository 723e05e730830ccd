"""The pipeline's stages one after the other, on planted cases."""

import os
import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [a + b for a in "the of and that with for are not from this have were".split() for b in ["", "ing", "ed", "er", "ly", "tion"]]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(n // 12))
    clean = [prose(240) for _ in range(60)]
    passage = prose(150)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i]) for i in range(5)]
    near = clean[10].split(" ")
    near[30] = "changed"
    rows += [(200, " ".join(near))]
    rows += [(300 + i, prose(120) + "\n" + passage + "\n" + prose(120)) for i in range(6)]
    rows += [(400 + i, " ".join(w + "$$$" for w in prose(120).split())) for i in range(8)]
    rows += [(500 + i, " ".join(w.upper() + "!!" for w in prose(120).split())) for i in range(8)]
    rows += [(600, None), (601, ""), (602, "ΩΨΞ" * 100 + " 漢字" * 200)]
    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("planted"))
    df.write.parquet(f"{folder}/documents.parquet")
    return folder, dict(rows), passage


def test_stages(spark, planted, tmp_path):
    folder, texts, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else docs.collect()
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    clean = set(range(60)) | set(range(100, 105)) | {200} | set(range(300, 306))
    assert clean <= set(kept["quality_rules"]) and not any(400 <= i < 602 for i in kept["quality_rules"])
    assert clean == set(kept["language_id"]) - {602}
    assert set(kept["ngram_join"]) - {602} == set(range(60)) | set(range(300, 306))
    for i in range(300, 306):
        assert passage[50:-50] not in kept["repeated_substrings"][i]
        assert texts[i][:100] in kept["repeated_substrings"][i]
    assert all(kept["repeated_substrings"][i] == texts[i] for i in range(60))
    last = kept["best_fit_packing"]
    assert {r["doc_id"] for r in last} == set(kept["repeated_substrings"])


def test_run(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    assert out.count() > 60 and "sequence_id" in out.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_queries_match_sql_on_small_tables(spark):
    import duckdb

    from feedback_engine.llm import registry

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{d}/{f}')")
    for name, sql in registry.ORACLE_SQL.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = registry.QUERIES[name](spark, d).select(*columns).collect()
        key = lambda rows: sorted(str(tuple(r)) for r in rows)
        assert key(got) == key(want.fetchall()), name
