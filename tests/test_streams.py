"""Streams that stop and go on, ids without a horizon, keyed merges, documents from many tasks, files of lines."""

import ast
import json
import os

import pytest
from pyspark.sql import functions as F

from feedback_engine.plans import catalogue
from feedback_engine.sinks import writers
from feedback_engine.sinks.keyed import KeyedTable
from feedback_engine.sources import pages, paged, readers
from feedback_engine.streaming import incremental

WAIT = 120


def put_pages(folder, language, pages_, start=0, summary=None):
    os.makedirs(f"{folder}/{language}", exist_ok=True)
    for i, ids in enumerate(pages_, start):
        records = [{"id": str(x), "text": f"t{x}", "created": x} for x in ids]
        page = {"reviews": records, "cursor": str(i + 1), "query_summary": summary} if summary and not i else records
        with open(f"{folder}/{language}/{i}.json", "w") as f:
            json.dump(page, f)


def run(stream, name, path, checkpoint):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(WAIT)
    return q


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


@pytest.fixture
def source(spark):
    spark.dataSource.register(paged.PagedSource)
    return lambda folder, **options: spark.readStream.format("paged").options(**options).load(str(folder))


def test_cursor_stream_goes_on_from_its_checkpoint(spark, source, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("pages", "out", "ck"))
    put_pages(folder, "en", [[1, 2, 3], [3, 4], [5]])
    put_pages(folder, "fr", [[11]])
    stream = lambda: incremental.once_each(source(folder, pagesPerPartition="2"), "id")
    run(stream(), "a", out, ck)
    assert ids(spark, out) == sorted(["1", "2", "3", "4", "5", "11"])
    # More pages, one of them repeating what was there; a new language; a gap that waits for its page.
    put_pages(folder, "en", [[5, 1], [6, 7]], 3)
    put_pages(folder, "de", [[21]])
    put_pages(folder, "fr", [[13]], 2)
    run(stream(), "b", out, ck)
    assert ids(spark, out) == sorted(["1", "2", "3", "4", "5", "6", "7", "11", "21"])
    put_pages(folder, "fr", [[12, 11]], 1)
    q = run(stream(), "c", out, ck)
    assert ids(spark, out) == sorted(["1", "2", "3", "4", "5", "6", "7", "11", "12", "13", "21"])
    assert ast.literal_eval(str(q.lastProgress["sources"][0]["endOffset"])) == {"en": "5", "fr": "3", "de": "1"}


def test_cursor_stream_stopped_in_the_middle(spark, source, tmp_path):
    """A batch that fails is read again from the same offsets, also if pages have come since."""
    folder, ck = str(tmp_path / "pages"), str(tmp_path / "ck")
    put_pages(folder, "en", [[1, 2], [3]])
    table = KeyedTable(spark, str(tmp_path / "table"), "id", buckets=4)
    batches = []

    def failing(df):
        batches.append(sorted(r["id"] for r in df.collect()))
        if len(batches) == 1:
            raise RuntimeError("stopped")
        return df

    with pytest.raises(Exception, match="stopped"):
        incremental.merged_by_key(source(folder), table, ck, failing).awaitTermination(WAIT)
    put_pages(folder, "en", [[3, 4]], 2)
    incremental.merged_by_key(source(folder), table, ck, failing).awaitTermination(WAIT)
    incremental.merged_by_key(source(folder), table, ck, failing).awaitTermination(WAIT)  # Spark ends a run after a replay
    assert batches[0] == batches[1] == ["1", "2", "3"] and batches[2] == ["3", "4"]
    assert sorted(r["id"] for r in table.read().collect()) == ["1", "2", "3", "4"]
    # The checkpoint is lost: the table knows what was seen.
    incremental.merged_by_key(source(folder), table, ck + "2").awaitTermination(WAIT)
    assert sorted(r["id"] for r in table.read().collect()) == ["1", "2", "3", "4"]


def test_totals_of_first_pages(spark, source, tmp_path):
    put_pages(tmp_path, "en", [[1], [2]], summary={"total_reviews": 9, "total_positive": 7, "total_negative": 2})
    put_pages(tmp_path, "fr", [[3]])
    got = spark.read.format("paged").option("what", "totals").load(f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got)) == [("en", 9, 7, 2), ("fr", None, None, None)]
    assert spark.read.format("paged").load(f"file://{tmp_path}").count() == 3


def test_seen_ids_have_no_horizon(spark, tmp_path):
    """An id that comes again months later, in a later run, is not emitted."""
    schema = "event_id long, ts timestamp"
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part, rows in enumerate(([(1, "2024-01-01"), (2, "2024-01-01"), (1, "2024-01-02")], [(3, "2024-06-01")], [(1, "2025-01-01"), (4, "2025-01-01")])):
        spark.createDataFrame(rows, "event_id long, ts string").select("event_id", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        run(incremental.once_each(stream), f"p{part}", out, ck)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def rows_of(table):
    return {r["k"]: (r["v"], r["t"]) for r in table.read().collect()}


def test_merges_in_any_order(spark, tmp_path):
    batches = [[("a", 1, "x"), ("b", 1, "x"), (None, 9, "gone")], [("a", 3, "z"), ("c", 2, "y")], [("a", 2, "y"), ("b", 1, "x"), ("c", 2, "w")]]
    want = None
    for i, order in enumerate(([0, 1, 2], [2, 1, 0], [0, 0, 1, 2, 1, 0])):
        table = KeyedTable(spark, str(tmp_path / f"t{i}"), "k", "v", buckets=3)
        for b in order:
            table.merge(spark.createDataFrame(batches[b], "k string, v long, t string"))
        got = rows_of(table)
        assert got.keys() == {"a", "b", "c"} and got["a"] == (3, "z") and table.read().count() == 3
        want = want or got
        assert got == want
    table.cleaned(1)
    assert rows_of(table) == want and len(table.manifests()) == 1
    assert table.merge(spark.createDataFrame([], "k string, v long, t string")) == 0


def test_a_merge_that_ends_early_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "v", buckets=3)
    table.merge(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, v long, t string"))
    before = rows_of(table)
    broken = KeyedTable(spark, table.path, "k", "v")
    monkeypatch.setattr(broken, "_swapped", lambda *_: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        broken.merge(spark.createDataFrame([("a", 5, "new"), ("z", 5, "new")], "k string, v long, t string"))
    assert rows_of(table) == before
    table.cleaned()
    assert rows_of(table) == before
    # Two merges from the same manifest: the second is refused and loses nothing.
    old = table.manifest()
    table.merge(spark.createDataFrame([("c", 1, "x")], "k string, v long, t string"))
    with pytest.raises(OSError):
        table._swapped(old, old["number"] + 1)
    assert rows_of(table).keys() == {"a", "b", "c"}


def test_enrichment_keeps_one_row_a_key(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    enrich = lambda df: df.select("id", "version", F.when(F.col("id") % 2 == 0, F.concat(F.lit("bad "), F.col("id").cast("string"))).alias("error"))
    table = KeyedTable(spark, str(tmp_path / "t"), "id", "version", buckets=4)
    for v in (2, 1):
        spark.range(60).select("id", F.lit(v).alias("version")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("id long, version int").parquet(folder)
        incremental.merged_by_key(stream, table, str(tmp_path / "ck"), enrich, log).awaitTermination(WAIT)
    assert table.read().count() == 60 and {r["version"] for r in table.read().collect()} == {2}
    done = spark.read.parquet(log).collect()
    assert sorted((r["number"], r["rows"], r["failed"], len(r["errors"])) for r in done) == [(0, 60, 30, 20), (1, 60, 30, 20)]
    assert set(done[0]["errors"]) == {f"bad {i}" for i in range(20, 60, 2)}


def read_document(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part"))
    return len(parts), json.loads("".join(open(f"{path}/{f}", encoding="utf-8").read() for f in parts))


def test_document_of_many_tasks(spark, tmp_path):
    path, n = str(tmp_path / "doc"), 300_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select((F.lit(n) - F.col("id")).alias("id"), F.lit("x" * 40).alias("s"))
        writers.document(df, path, {"app": 1}, order=["id"])
        n_parts, got = read_document(path)
        assert n_parts > 1 and [r["id"] for r in got["rows"]] == list(range(1, n + 1)) and got["app"] == 1
        sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part")]
        assert max(sizes) < 0.7 * sum(sizes)
        # A job that fails leaves the old document whole.
        bad = spark.range(10).select(F.raise_error(F.lit("stop")).alias("id"))
        with pytest.raises(Exception, match="stop"):
            writers.document(bad, path, {})
        assert read_document(path)[1] == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_read_from_files(spark):
    df = catalogue.QUERIES["scan_jsonl"](spark, "/root/testdata/sf0.001")
    assert "FileScan json" in df._jdf.queryExecution().executedPlan().toString()


def test_lines_that_are_no_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\n\n{"id": 2\n[1]\nnull\n{"id": "x"}\n{"id": 3, "more": {"a": 1}}\n')
    got = readers.jsonl(spark, str(tmp_path / "x.jsonl"), "id long, t string")
    assert sorted((r["id"], r["t"]) for r in got.collect() if r["id"] is not None) == [(1, "a"), (3, None)]


def test_released_pages(spark):
    rows = [(1, "4.6.0", "<p>x</p>"), (2, "beta-1", "<p>x</p>"), (3, "Season_1", "<nav>m</nav>"), (4, "Season_1", "<p>y</p>"), (5, None, "<p>z</p>"), (6, "2.0", None)]
    got = pages.released(spark.createDataFrame(rows, "page_id int, version string, html string"), "^beta")
    assert sorted((r["page_id"], r["season"], r["text"]) for r in got.collect()) == [(1, "S4", "x"), (4, "S1", "y")]
