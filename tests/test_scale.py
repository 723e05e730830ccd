"""Operators over whole tables: scans by ranges, intervals, prefixes, n-grams, the canonicaliser's fixed point."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from feedback_engine.functions import canonical, text
from feedback_engine.operators import issues, periods, scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    # Few values, many ties and nulls, one value with a third of the rows, and rows that are equal throughout.
    rows = [(i, 7 if i % 3 == 0 else rng.choice([None, *range(9)]), rng.choice([None, 1, 2, 50])) for i in range(900)] + [(5, 5, 5)] * 40
    return rows, spark.createDataFrame(rows, "i int, k int, v long")


def test_places_and_running_sums(numbers):
    rows, df = numbers
    order = [F.asc_nulls_last("k"), F.desc("i")]
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    got = sorted(scan.running(df, order, "v", "sum", parts=7).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, len(rows) + 1)) and [(r["i"], r["k"], r["v"]) for r in got] == want
    total = 0
    for r in got:
        total += r["v"] or 0
        assert r["sum"] == total
    assert [tuple(r)[:3] for r in scan.placed(df, order, parts=5).orderBy("place").collect()] == want


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, v long, m map<string,int>")
    assert scan.placed(empty, [F.asc("k")]).count() == 0 and scan.running(empty, [F.asc("k")], "v").count() == 0
    assert scan.with_progress(empty, [F.asc("k")], "v").count() == 0


def test_last_known(numbers):
    rows, df = numbers
    last, want = None, {}
    for r in sorted(rows[:900]):
        last = r[2] if r[2] is not None else last
        want[r[0]] = last
    got = scan.last_known(df.limit(900), [F.asc("i")], "v", parts=6)
    assert {r["i"]: r["v"] for r in got.collect()} == want


def test_no_task_sorts_all(spark, numbers):
    """Hot values are divided among ranges."""
    from pyspark.sql.functions import lit

    rows = scan._ranged(spark.range(4000).select(lit(1).alias("k")), [F.asc("k")], 8)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


INTERVALS = "ord int, season string, start_ts timestamp_ntz, end_ts timestamp_ntz"


def day(n):
    return None if n is None else datetime.datetime(2000, 1, 1) + datetime.timedelta(days=n)


def first_holding(rows, ts):
    found = sorted((o, s) for o, s, a, b in rows if ts is not None and (a is None or ts >= a) and (b is None or ts < b))
    return found[0] if found else (None, "none")


@pytest.mark.parametrize("seed", range(3))
def test_intervals_by_either_path(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        a = rng.choice([None, *range(0, 400)]) if rng.random() < 0.1 else rng.randrange(400)
        n = rng.choice([0, -3, 1, 1, 5, 40, 36500, None])
        rows.append((rng.randrange(30), f"s{i % 25}", day(a), day(None if n is None or a is None and rng.random() < 0.5 else (a or 0) + n)))
    rows += [(40, "touch", day(10), day(20)), (41, "touch", day(20), day(30)), (29, "same", day(50), day(60)), (29, "same", day(50), day(60))]
    if seed == 2:
        rows = [r for r in rows if r[2] is not None and r[3] is not None and r[3] < day(1000)]
    times = [day(rng.randrange(-50, 500)) for _ in range(300)] + [None, None] + [day(10)] * 100 + [t for r in rows for t in r[2:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    table = spark.createDataFrame(rows, INTERVALS)
    want = {i: first_holding(rows, t) for i, t in enumerate(times)}
    for given in (table, rows):
        for case_rows in (1000, 0):
            got = periods.with_period(df, given, outside="none", case_rows=case_rows)
            assert got.columns == ["i", "ts", "ord", "season"]
            assert {r["i"]: (r["ord"], r["season"]) for r in got.collect()} == want
    assert got.count() == len(times)


def test_prefixes_by_equality(spark):
    names = ["Light", "Light Class", "Light Class Armor", "RPG", "RPG-7", "", "ü", "übung", "C4"]
    entities = [(n, t) for n, t in zip(names, [5, 9, 9, 3, 3, 99, 1, 1, 2], strict=True)]
    things = ["Light", "Light Class A", "Li", "RPG-", "RPG-7 ammo", "C", "übungen", "nothing", "", None, "Light"]
    got = issues.matched_entities(spark.createDataFrame([(t,) for t in things], "item string"), spark.createDataFrame(entities, "entity string, total long"))

    def brute(item):
        if not item:
            return None
        found = [(e != item, -t, e) for e, t in entities if e and (item.startswith(e) or e.startswith(item))]
        return min(found)[2] if found else None

    assert sorted([(r["item"], r["entity"]) for r in got.collect()], key=str) == sorted([(t, brute(t)) for t in things], key=str)


def test_prefixes_of_many(spark):
    entities = spark.range(100_000).select(F.concat(F.lit("unit "), F.col("id").cast("string")).alias("entity"), F.col("id").alias("total"))
    items = spark.range(100_000).select(F.concat(F.lit("unit "), (F.col("id") + 50_000).cast("string"), F.lit(" x")).alias("item"))
    got = issues.matched_entities(items, entities)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    first = got.filter("item = 'unit 70123 x'").collect()
    assert [r["entity"] for r in first] == ["unit 70123"] and got.filter("entity is null").count() == 0


def test_ngrams_are_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(n)),)] * 3, "t string")
        made = df.select(F.size(text.ngrams(F.col("t"), 2)).alias("n"))
        assert made.first()["n"] == n - 1
        began = time.perf_counter()
        made.collect()
        return time.perf_counter() - began

    seconds(100)
    short, long = min(seconds(2000) for _ in range(2)), min(seconds(8000) for _ in range(2))
    assert long < 5 * short + 0.5
    short = spark.createDataFrame([("one",), ("",), (None,), ("one two",)], "t string")
    assert [r[0] for r in short.select(text.ngrams(F.col("t"), 2, ())).collect()] == [[], [], [], ["one two"]]


def test_fixed_point_of_any_table(spark):
    chain = {f"t{i}": f"T{i + 1}" for i in range(9)}
    tables = canonical.Tables(overrides={"T9: a": "T0: b", "x": "y: lovely"}, prefixes=chain, suffixes={"lovely": "great", "nice": "lovely", "great stuff": "nice"})
    assert tables.passes() >= 9
    cases = ["t0: a", "T3: nice", "x", "y: z", "plain", "t8: great stuff", "Audio: nice", "audio: great stuff", ": b", "a: ", ""]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "text string")
    got = {r["text"]: r["canonical"] for r in canonical.canonicalised(df, tables=tables, passes=None).collect()}
    assert got.pop(None) is None
    for c, made in got.items():
        at = c
        for _ in range(40):
            at = tables.once(at)
        assert made == at and tables.once(made) == made
    once = {r["text"]: r["canonical"] for r in canonical.canonicalised(df, tables=tables).filter("text is not null").collect()}
    assert once == {c: tables.once(c) for c in cases}
    same = df.select("text", canonical.canonical(F.col("text"), tables).alias("c")).filter("text is not null")
    assert {r["text"]: r["c"] for r in same.collect()} == once
    for circle in ({"a": "B", "b": "A"}, {"a": "B", "b": "C", "c": "A"}):
        with pytest.raises(ValueError):
            canonical.Tables(prefixes=circle).passes()


def test_own_tables_reach_their_fixed_point():
    tables = canonical.Tables()
    n = tables.passes()
    assert n == 2
    for t in tables._texts():
        for _ in range(n):
            t = tables.once(t)
        assert tables.once(t) == t


def test_patterns_with_and_without_other_letters(spark):
    """Rules with a dictionary, without one, and Python's own search agree."""
    import re

    rules = [("low", [r"\bonline\b.*(?:dead|dying|мертв)"]), ("ban", [r"\bban\b.*(?:модификац|reason)", r"\bbanned\b"]), ("far", [r"\bимб\w+\b", r"\bmé?lé\b"]), ("any", [r"\b\d+\s*°", r"(?:x|ж)y"]), ("plain", [r"\bcheat(?:er)?s?\b", r"heat wave"])]
    texts = ["online is DEAD", "online and мертвый", "online", "a ban for REASON", "ban модификаций", "имба", "ИМБАЛАНС", "симба", "mélé", "mlé", "MÉLÉ", "30 °", "xy", "жY", "cheaters", "cheat wave", "heat wave", "", "é" * 50, "a cheat\nhéat wave"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {i: [n for n, ps in rules if any(re.search(p, t, re.I) for p in ps)] for i, t in enumerate(texts)}
    assert {r["i"]: r["t"] for r in df.select("i", text.tags(F.col("text"), rules).alias("t")).collect()} == want
    own, bare, known = text.prepared(df, [p for _, ps in rules for p in ps])
    assert {r["i"]: r["t"] for r in own.select("i", text.tags(F.col("text"), rules, bare, known).alias("t")).collect()} == want


def test_examples_match_their_patterns():
    import re

    from feedback_engine.functions import rule_tables

    for rules in (rule_tables.NEGATIVE, rule_tables.POSITIVE):
        for p in [p for ps in rules.values() for p in ps if not p.isascii()]:
            assert re.search(p, text.example(p), re.I), p


def test_tables_of_scans_can_be_removed(spark):
    import os

    df = scan.placed(spark.range(10).toDF("k"), [F.asc("k")])
    assert df.count() == 10
    folders = list(scan._folders)
    assert folders and all(os.path.isdir(f.removeprefix("file://")) for f in folders)
    scan.cleaned(spark)
    assert not scan._folders and not any(os.path.isdir(f.removeprefix("file://")) for f in folders)
