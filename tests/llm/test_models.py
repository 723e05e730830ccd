"""Quality classifier and language identification."""

import math
import random

import pytest

from feedback_engine.llm import language_id, quality_classifier
from feedback_engine.llm.common import fold

STEMS = {"en": "the of and that with ing tion ness".split(), "de": "der und nicht lich keit ung schaft über".split(), "fr": "les des est pour eux tion ment être".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = []
    for i in range(360):
        lang = list(STEMS)[i % 3]
        words = ["".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(40, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "%%%" for w in words) if bad else " ".join(words), lang, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_language_of_held_out_documents(spark, corpus, odd_docs, folder):
    d = folder(documents=corpus.drop("quality").unionByName(odd_docs.select("doc_id", "text", "lang").filter("doc_id is null or text is null or text = ''")))
    rows = language_id.op7_language_id(spark, d).collect()
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, corpus, odd_docs):
    model = language_id.learned(corpus, corpus["text"], corpus["lang"])
    got = {r["row"]["doc_id"]: r["found"] for r in language_id.predicted(odd_docs.filter("doc_id in (1, 2, 3, 9)"), model, keep=["doc_id"]).collect()}
    assert all(x["lang_pred"] == "und" and x["rejected"] and x["score"] == 0 for x in got.values())
    assert not model.predict("the with that and " * 30)[2]
    assert model.predict("zzzq xxjk qqwx " * 30)[2]
    kept = language_id.known_languages(corpus.unionByName(odd_docs.select("doc_id", "text", "lang").limit(3), allowMissingColumns=True))
    assert kept.columns == corpus.columns and kept.count() >= 355
    assert language_id.known_languages(odd_docs.limit(0)).count() == 0


def test_nothing_learned_keeps_documents(spark):
    rows = spark.createDataFrame([(1, "a text", None), (2, "漢字", None), (3, "12 %", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language_id.known_languages(rows).collect()) == [1, 2]


def test_no_language_is_left_out(spark, corpus):
    assert language_id.learned(corpus, corpus["text"], corpus["lang"], languages=3).languages == ["de", "en", "fr"]
    with pytest.raises(ValueError, match="more than 2"):
        language_id.learned(corpus, corpus["text"], corpus["lang"], languages=2)


def test_long_text_is_counted_in_blocks(monkeypatch):
    text = "the quick brown für étés " * 400
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 999)
    assert (whole == language_id.counts(text)).all()


def plain_scores(text, model):
    """The cosine with every centroid, from its definition."""
    raw = " ".join("".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower()).split())
    raw = f" {raw} ".encode() if raw else b""
    tf = {}
    for n, factor in ((2, 2654435761), (3, 2246822519)):
        for i in range(len(raw) - n + 1):
            bucket = int.from_bytes(raw[i : i + n], "big") * factor % 2**32 >> 19
            tf[bucket] = tf.get(bucket, 0) + 1
    v = {b: math.log(1 + x) * float(model.idf[b]) for b, x in tf.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return [sum(x * float(model.weighted[b, j]) / float(model.idf[b]) for b, x in v.items()) / norm for j in range(model.weighted.shape[1])]


def test_prediction_against_its_definition(spark, corpus):
    model = language_id.learned(corpus, corpus["text"], corpus["lang"])
    for text in ("the with that and über 12 der", "x", "Ünd\t nicht--lich", "漢字 für"):
        want = plain_scores(text, model)
        lang, score, rejected = model.predict(text)
        assert score == pytest.approx(max(want), abs=1e-4) and lang == model.languages[model.owner[want.index(max(want))]]
        assert rejected == (score < model.least[model.languages.index(lang)])
    assert all(model.predict(x) == ("und", 0.0, True) for x in ("½ ² 12", "", None, "_-"))


def test_stage_rejects_what_no_language_is_near(spark, corpus):
    rng = random.Random(3)
    noise = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(90))
    alphabets = ["абвгдежзиклмнопрстуфхцчшыя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是不了在人有我他这个们中来上大为和国", "bcdfghjklmnpqrstvwxz"]
    junk = [(1000 + i, noise(alphabets[i % 4]), None, 0) for i in range(20)]
    rows = corpus.unionByName(spark.createDataFrame(junk, corpus.schema)).selectExpr("*", "doc_id AS row", "text AS found", "1 AS `a.b`")
    kept = language_id.known_languages(rows)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == rows.columns and not ids & set(range(1000, 1020)) and len(ids) >= 355


def test_score_against_its_definition(spark, corpus):
    model = quality_classifier.learned(corpus, corpus.selectExpr("doc_id", "quality AS label"))
    mask = 2**64 - 1
    for text in ("der der und%%% x", "the with\nthat", "a", "ß"):
        raw = text.encode()
        words = []
        for w in raw.split():
            h = sum(int(quality_classifier._BYTE[c]) * int(quality_classifier._PLACE[i & 63]) for i, c in enumerate(w)) * 0x9E3779B97F4A7C15 & mask
            words.append(h ^ h >> 31)
        at = [h * 0x9E3779B97F4A7C15 % 2**64 >> 48 for h in words]
        at += [65536 + (0 if a == b else (a * 0xD6E8FEB86659FD93 + b) * 0x9E3779B97F4A7C15 % 2**64 >> 48) for a, b in zip(words, words[1:], strict=False)]
        at += [131072 + (int.from_bytes(raw[i : i + 3], "big") * 2246822519 % 2**32 >> 16) for i in range(len(raw) - 2)]
        want = 1 / (1 + math.exp(-(sum(float(model.gain[i]) for i in at) / max(len(at), 1) + model.bias)))
        assert model.score(text) == pytest.approx(want, abs=1e-5)


def test_no_documents(spark, odd_docs, folder):
    d = folder(documents=odd_docs.limit(0), labels=spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert quality_classifier.op5_quality_classifier(spark, d).count() == 0
    assert language_id.op7_language_id(spark, d).count() == 0


def test_quality_of_held_out_documents(spark, corpus, odd_docs, folder):
    d = folder(documents=corpus.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text").filter("doc_id is null or text is null")), labels=corpus.select("doc_id", "quality").unionByName(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")))
    rows = quality_classifier.op5_quality_classifier(spark, d).collect()
    truth = {r["doc_id"]: r["quality"] for r in corpus.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_no_labels(spark, odd_docs, folder):
    d = folder(documents=odd_docs, labels=spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.op5_quality_classifier(spark, d).collect()} == {0.5}


def test_folds(spark):
    import zlib

    rows = spark.range(50)
    got = [r[0] for r in rows.select(fold(rows["id"], 3)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in range(50)]
