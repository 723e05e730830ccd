"""Streaming counterparts: timelines, deduplicated ingest, micro-batch enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedback_engine.functions.numbers import count_if
from feedback_engine.sinks.keyed import KeyedTable


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts as a timestamp that watermarks accept."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def timeline(stream: DataFrame, width: str = "1 day", late: str = "1 hour", negative: str = "error") -> DataFrame:
    """Totals and negatives of each time bucket; the same on a batch table."""
    rows = event_time(stream)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counts = rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("total"), count_if(F.col("event_type") == negative).alias("negative"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total", "negative")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    rows = event_time(stream)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(stream: DataFrame, key: str = "event_id", late: str | None = None) -> DataFrame:
    """Rows of keys that were not seen before, however long ago.

    State holds each key once and is never dropped, some 100 bytes a key: beyond
    some tens of millions of keys a task, set Spark's RocksDB state store, which
    keeps it on disk. With `late`, keys are forgotten that long after their event
    time, and state is bounded by what comes within it.
    """
    if late is None:
        return stream.dropDuplicates([key])
    return event_time(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def merged_by_key(stream: DataFrame, table: KeyedTable, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None, log: str | None = None, every: int = 1) -> StreamingQuery:
    """Merge every micro-batch, enriched, into a keyed table: a batch that is replayed or comes late changes nothing but what it should.

    A row a key stays: that of the highest version, or without a version the first
    one, which is ingest that never repeats an id, also after the checkpoint is
    lost, since the table itself is what was seen. enrich runs once a batch. With
    `log`, a folder, every `every`-th batch adds a row to it: the batch, its rows,
    rows with an error and the last 20 errors.
    """

    def batch(df: DataFrame, number: int) -> None:
        made = (enrich(df) if enrich else df).persist()  # read for the buckets and for the rows
        try:
            table.merge(made)
            if log and number % every == 0:
                progress(made, number).write.mode("overwrite").parquet(f"{log}/batch={number}")
        finally:
            made.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(results: DataFrame, number: int, n: int = 20) -> DataFrame:
    """One row: the batch, its rows, rows with an error, and the last n errors by key, if there is a column `error`."""
    if "error" not in results.columns:
        return results.agg(F.lit(number).alias("number"), F.count("*").alias("rows"), F.lit(0).cast("long").alias("failed"), F.array().cast("array<string>").alias("errors"))
    key = results.columns[0]
    last = results.filter("error is not null").orderBy(F.desc(key)).limit(n).agg(F.collect_list("error").alias("errors"))  # n at most
    return results.agg(F.lit(number).alias("number"), F.count("*").alias("rows"), F.count("error").alias("failed")).crossJoin(last)


def enriched(stream: DataFrame, classify: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch enrichment on every micro-batch; a batch that is replayed overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        classify(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
