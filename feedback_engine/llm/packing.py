"""Best-fit packing with certified bounds.

Documents are tokenised and cut into pieces of at most the capacity. Full pieces
are sequences of their own. The others are dealt into partitions of bounded
size; each packs its pieces by best-fit decreasing and compares its number of
sequences with a lower bound from dual feasible functions. Sequences with a gap
go back to a pool; the pool is dealt anew into fewer partitions, so documents
move between them, and is packed again, until all sequences together meet the
bound of the whole input or a round saves none.

Only (doc_id, piece, length, checksum) rows are shuffled, never ids. The driver
sees a histogram of at most `capacity` lengths.

Defined cases: a null text is empty and so one end id; each row is a document of
its own, so repeated rows and null ids are packed as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm import tokens
from feedback_engine.llm.common import small_batches, table, written

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document (columns doc_id and text)."""
    small_batches(docs.sparkSession)
    path = path or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.document_bytes(text.as_py(), encode)
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that lengths with these counts (by length, 0 to capacity) need at least."""
    length = np.arange(capacity + 1)
    counts = counts.astype(np.int64)
    best = math.ceil(int((counts * length).sum()) / capacity)
    # f_s: lengths above capacity - s fill a sequence, those below s count nothing.
    number, total = np.cumsum(counts), np.cumsum(counts * length)
    s = np.arange(1, capacity // 2 + 1)
    filled = (number[-1] - number[capacity - s]) * capacity + total[capacity - s] - total[s - 1]
    best = max(best, int(-(-filled.max() // capacity))) if len(s) else best
    # u_k: multiples of capacity / (k + 1) count as they are, others round to floor((k + 1) x / capacity) / k.
    for k in range(1, 21):
        whole, part = np.divmod((k + 1) * length, capacity)
        scaled = np.where(part == 0, k * length, whole * capacity)  # k times the function
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For each length its bin and its offset there, and what is left in each bin. Lengths are taken in the order of a stable descending sort."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0  # bit r is set if a bin with r left is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = have >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                have &= ~(1 << r)
        else:
            b, r = len(left), capacity
            left.append(capacity)
        where[i], offset[i] = b, capacity - r
        left[b] = r - n
        if r > n:
            open_bins[r - n].append(b)
            have |= 1 << (r - n)
    return where, offset, left


def packed(rows: DataFrame, capacity: int = CAPACITY, partition_rows: int = 50_000, rounds: int = 8, fewer: int = 4) -> DataFrame:
    """rows (PIECES) with sequence_id and offset; a written table."""
    spark = rows.sparkSession
    rows = written(rows, "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    bound = lower_bound(histogram, capacity)
    done = [rows.filter(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() + (1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, n = rows.filter(F.col("length") < capacity), int(histogram[:-1].sum())
    closed, last = int(histogram[-1]), None
    parts = max(1, math.ceil(n / partition_rows))
    for step in range(rounds):
        if not n:
            break

        def run(batches: Iterator[pd.DataFrame], step: int = step) -> Iterator[pd.DataFrame]:
            frames = [b for b in batches if len(b)]
            if frames:
                own = pd.concat(frames).sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
                lengths = own["length"].to_numpy()
                where, offset, left = best_fit_decreasing(lengths, capacity)
                gaps = np.array(left)
                certified = len(left) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
                # A certified partition gives away only what others may fill; any other one all sequences with a gap.
                again = gaps > (capacity // 64 if certified else 0)
                yield own.assign(sequence_id=(step << 52) + (TaskContext.get().partitionId() << 28) + where, offset=offset, again=again[where])

        # The row's place is part of the key: rows that share a null id, or repeat each other, are dealt as evenly as others.
        made = written(pool.repartition(parts, "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()).mapInPandas(run, PACKED + ", again boolean"), f"packed-{step}")
        seen = made.groupBy("again").agg(F.count("*").alias("n"), F.sum((F.col("offset") == 0).cast("long")).alias("bins"))
        by = {r["again"]: (r["n"], r["bins"]) for r in seen.collect()}
        again, sequences = by.get(True, (0, 0)), closed + sum(b for _, b in by.values())
        if sequences <= bound or not again[0] or last is not None and sequences >= last or parts == 1 or step == rounds - 1:
            done.append(made.drop("again"))
            break
        done.append(made.filter(~F.col("again")).drop("again"))
        pool, n, last = made.filter("again").select(rows.columns), again[0], sequences
        closed += by.get(False, (0, 0))[1]
        parts = max(1, min(parts // fewer, math.ceil(n / partition_rows)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packed(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
