"""Exact repeated substrings across a corpus, by enhanced suffix arrays on candidates.

Every window of `least` bytes that occurs twice is found and its bytes removed.
A suffix array of the whole corpus would have to be sorted across machines, so
positions are first narrowed without loss:

1. Anchors. A window belongs to the smallest hash among its own k-grams, its
   anchor; equal windows have equal anchors at equal places.
2. An anchor whose k-gram occurs once owns no repeated window. One whose context
   (all bytes of its windows) is the same at every occurrence owns only repeated
   ones. Both are decided by counts, which combine before the shuffle.
3. The rest, where repeats begin and end: their distinct contexts, a few hundred
   bytes each, are gathered by anchor. For them an enhanced suffix array is
   built; a stack scan of its common prefixes walks the interval tree, and an
   interval whose left neighbours differ is a maximal repeat, with all its
   occurrences. Anchors with more than `most` distinct contexts (a passage cut
   out of very many different texts) are not gathered: blocks of their windows
   are counted by digest instead, which is as exact and spreads over all machines.

Texts are shuffled once, to bring candidates to them, and contexts once. A key
that a large share of all rows has (a passage in a third of all documents) is
dealt into parts, each of which meets what is known of the key.

Defined cases: a null text is empty; texts shorter than `least` keep all bytes;
repeated rows repeat each other; matches never cross documents; bytes are
judged on the input; an empty table gives an empty result; a null id stays null
and is not -1. Where the kept bytes
are used as text, what is left of a cut character goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import dropped, folder_of, met, small_batches, table, written

LEAST = 400
#: A text loses what it shares from so many bytes and words on: repeats are found by bytes, in texts of short words too, and those of fewer words stay.
PASSAGE, WORDS = 200, 50
#: A part between blanks counts as one word, and as one more for each so many bytes: scripts without blanks have words, too.
WORD_BYTES = 16
GRAM = 48
BLOCK = 1 << 18
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + 4096
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding(x: np.ndarray, w: int, f: np.ufunc, pad: np.uint64) -> np.ndarray:
    """f over each w consecutive values."""
    n = len(x) - w + 1
    whole = np.full(-(-len(x) // w) * w, pad, x.dtype)
    whole[: len(x)] = x
    rows = whole.reshape(-1, w)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(k-gram hash, position, first, last window) of each anchor of a text. A window's anchor is the leftmost of its smallest k-grams, so it follows from the window's bytes alone; windows of an anchor are consecutive."""
    w, found = least - GRAM + 1, []
    up, down = _powers()
    for at in range(0, max(len(data) - least + 1, 0), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + least - 1, len(data) - at), at)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1]
        h = (h ^ h >> np.uint64(32)) * _MIX
        h ^= h >> np.uint64(29)
        smallest = _sliding(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
        runs = np.flatnonzero(np.concatenate(([True], smallest[1:] != smallest[:-1])))  # windows with one smallest hash
        own = np.flatnonzero(_is_smallest(h, smallest, w))
        places: dict[int, list[int]] = {}
        for i, v in zip(own.tolist(), h[own].tolist(), strict=True):
            places.setdefault(v, []).append(i)
        for first, last, v in zip(runs.tolist(), [*(runs[1:] - 1).tolist(), len(smallest) - 1], smallest[runs].tolist(), strict=True):
            for i in places[v]:
                if i >= first:
                    upto = min(last, i)
                    if found and found[-1][1] == i + at:  # goes on from the block before
                        found[-1] = (v, i + at, found[-1][2], upto + at)
                    else:
                        found.append((v, i + at, first + at, upto + at))
                    if upto == last:
                        break
                    first = upto + 1
    return found


def _is_smallest(h: np.ndarray, smallest: np.ndarray, w: int) -> np.ndarray:
    """Whether a hash is the smallest of some window that covers it."""
    covering = np.zeros(len(smallest) + 2 * (w - 1), np.uint64)
    covering[w - 1 : w - 1 + len(smallest)] = smallest
    return _sliding(covering, w, np.maximum, np.uint64(0)) == h


# --- the enhanced suffix array of a batch of contexts ---


def suffix_array(texts: list[bytes], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, common prefixes with the suffix before, text of each suffix, start in it) of the suffixes that begin in the first `starts` bytes of each text. Suffixes and prefixes end with their text."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    n, longest = len(raw), int(sizes.max(initial=0))
    base = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = base[1:][owner] - np.arange(n)  # bytes to the end of the own text
    code, h = np.zeros(n, np.int64), 7
    for j in range(h):  # 7 bytes of 9 bits
        code <<= 9
        code[: n - j] |= np.where(left[: n - j] > j, raw[j:], 0)
    ranks = []
    while True:
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
        ranks.append((h, rank.astype(np.int32)))
        if h >= longest:
            break
        later = np.zeros(n, np.int64)
        later[: n - h] = np.where(left[: n - h] > h, rank[h:] + 1, 0)
        code, h = rank * (n + 2) + later, 2 * h
    begins = np.concatenate([np.arange(b, b + s) for b, s in zip(base[:-1], starts, strict=True)]) if texts else np.zeros(0, np.int64)
    sa = begins[np.argsort(ranks[-1][1][begins], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    a, b = sa[:-1], sa[1:]
    common, most = np.zeros(len(b), np.int64), np.minimum(left[a], left[b])
    for size, rank in reversed(ranks):
        inside = common + size <= most
        common += np.where(inside & (rank[np.minimum(a + common, n - 1)] == rank[np.minimum(b + common, n - 1)]), size, 0)
    for _ in range(6):
        common += (common < most) & (raw[np.minimum(a + common, n - 1)] == raw[np.minimum(b + common, n - 1)])
    lcp[1:] = common
    return sa, lcp, owner[sa], sa - base[owner[sa]]


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(depth, first, last, own) of each maximal repeat of `least` or more, by a stack scan of the common-prefix interval tree.

    left: the symbol before each suffix; an interval counts as maximal if they
    differ. Occurrences are the suffixes first to last; own are those for which
    no deeper interval is found.
    """
    values = lcp.tolist() + [0]
    before = left.tolist()
    stack: list[list] = []  # depth, first, left symbol or None if they differ, own
    for i in range(1, len(values)):
        depth = values[i] if values[i] >= least else 0
        first, carried, free = i - 1, before[i - 1], [i - 1]
        while stack and stack[-1][0] > depth:
            d, lo, symbol, own = stack.pop()
            symbol = symbol if symbol == carried else None
            own += free
            if symbol is None:
                yield d, lo, i - 1, own
            first, carried, free = lo, symbol, []
        if depth and stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2] = top[2] if top[2] == carried else None
            top[3] += free
        elif depth:
            stack.append([depth, first, carried, free])


def covers(texts: list[bytes], starts: list[int], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each text the byte ranges covered by maximal repeats of the batch."""
    sa, lcp, owner, start = suffix_array(texts, starts)
    raw = b"".join(texts)
    codes = np.frombuffer(raw, np.uint8).astype(np.int64)
    left = np.where(start > 0, codes[sa - (sa > 0)] if len(sa) else 0, -1 - np.arange(len(sa)))  # the start of a context differs from all
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for depth, _, _, own in intervals(lcp, left, least):
        for i in own:
            found[owner[i]].append((int(start[i]), int(start[i]) + depth))
    return [merged(x) for x in found]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


# --- the distributed plan ---


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


RANGE = pa.list_(pa.int32())


def _emit_anchors(least: int):
    schema = pa.schema([(c, pa.int64()) for c in ("id", "h", "key", "ctx", "lo", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                columns: list[list[int]] = [[], [], [], [], [], []]
                for own, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    data = text.as_buffer().to_pybytes()
                    for key, _, first, last in anchors(data, least):
                        ctx = hashlib.blake2b(data[first : last + least], digest_size=8).digest()
                        for column, x in zip(columns, (own, h, key - (1 << 63), int.from_bytes(ctx, "little", signed=True), first, last + least), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def spans(docs: DataFrame, least: int = LEAST, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """For docs (doc_id long, id long, h long, text string; see hashed()):

    held: (doc_id, id, h, text, candidates), the rows that may have something to
    remove. marks: (id, h, spans), a written table with a flat array of maximal
    runs [from, to) of the bytes to remove.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "id", "h", "text")
    every = written(docs.select("id", "h", "text").mapInArrow(_emit_anchors(least), "id long, h long, key long, ctx long, lo long, stop long"), "anchors")
    keys = every.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).filter("n > 1").select("key", "n", (F.col("a") != F.col("b")).alias("mixed"))
    keys = written(keys, "keys")
    # A row that occurs more than once has each anchor more than once; lists hold each once, and copies share one list.
    per_doc = met(every, keys, "key", "n", every.count()).groupBy("id", "h").agg(F.collect_set(F.struct("lo", "stop", "mixed", "key", "ctx")).alias("candidates"))
    per_doc = written(per_doc, "per-doc")
    held = written(docs.join(per_doc, ["id", "h"]), "candidates")
    dropped(spark, folder_of(every), folder_of(keys))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("key", pa.int64()), ("ctx", pa.int64()), ("starts", pa.int32()), ("bytes", pa.binary())]
        for batch in batches:
            for text, found in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                yield _batch([(c["key"], c["ctx"], c["stop"] - least - c["lo"] + 1, data[c["lo"] : c["stop"]]) for c in found.as_py()], types)

    mixed = held.select("text", F.filter("candidates", lambda c: c["mixed"]).alias("c")).filter("size(c) > 0")
    # A context's digest stands for its bytes; copies count before they travel.
    contexts = written(mixed.mapInArrow(emit, "key long, ctx long, starts int, bytes binary").groupBy("key", "ctx").agg(F.first("starts").alias("starts"), F.first("bytes").alias("bytes"), F.count("*").alias("n")), "contexts")
    sizes = written(contexts.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("uses")), "sizes")
    totals = sizes.agg(F.sum("m").alias("m"), F.sum("uses").alias("uses"), F.max("m").alias("most")).first()
    grouped = met(contexts.select("key", "ctx", "starts", "bytes"), sizes.select("key", "m", F.col("m").alias("n")), "key", "n", totals["m"] or 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("key", pa.int64()), ("ctx", pa.int64()), ("ranges", RANGE)]
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = covers([r[3] for r in rows], [r[2] for r in rows], least)
            return _batch([(r[0], r[1], [x for s in f for x in s]) for r, f in zip(rows, found, strict=True) if f], types)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > 200_000 and row[0] != rows[-1][0]:
                    yield flush()
                    rows.clear()
                    size = 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush()

    ranges = "key long, ctx long, ranges array<int>"
    few = grouped.filter(F.col("m") <= most).select("key", "ctx", "starts", "bytes")
    found = few.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(scan, ranges)
    if (totals["most"] or 0) > most:
        found = found.unionByName(counted(written(grouped.filter(F.col("m") > most).select("key", "ctx", "starts", "bytes"), "many"), least))
    uses = per_doc.select("id", "h", F.explode("candidates").alias("c")).select("id", "h", "c.*")
    # What is known of a context: its own repeated ranges, and whether the whole of it is copied.
    known = contexts.select("key", "ctx", "n").join(found, ["key", "ctx"], "left").filter("n > 1 or ranges is not null")
    whole = uses.filter("not mixed").select("id", "h", F.array(F.col("lo"), F.col("stop")).alias("r"))
    partly = met(uses.filter("mixed").select("key", "ctx", "id", "h", "lo", "stop"), known.withColumn("copied", F.col("n") > 1), ["key", "ctx"], "n", totals["uses"] or 0)
    partly = partly.select("id", "h", F.when(F.col("copied"), F.array("lo", "stop")).otherwise(F.transform("ranges", lambda x: x + F.col("lo"))).alias("r"))
    marks = written(whole.unionByName(partly).groupBy("id", "h").agg(F.flatten(F.collect_list("r")).alias("spans")), "marks")
    dropped(spark, folder_of(contexts), folder_of(sizes), folder_of(per_doc))
    return held, marks


def counted(many: DataFrame, least: int, blocks: tuple[int, ...] = (32, 4, 1)) -> DataFrame:
    """(key, ctx, ranges) of the repeated windows of contexts (key, ctx, starts, bytes), by counting digests.

    A block of k consecutive windows has a core, the bytes all of them hold, and
    a hull, the bytes any of them holds. A core that occurs once leaves nothing
    repeated, a hull that occurs twice leaves everything; only the blocks between
    are divided further.
    """

    def level(k: int, upto: int | None):
        types = [("key", pa.int64()), ("ctx", pa.int64()), ("block", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("core", pa.binary()), ("hull", pa.binary())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, ctx, starts, data, todo in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    rows, at = [], anchors(data, least)[0][1]
                    # Blocks are cut by the distance to the anchor, so equal windows are in equal blocks.
                    nearest, farthest = at - starts + 1, at
                    for begin in [nearest // k * k] if todo is None else todo:
                        for d in range(begin, min(farthest, begin + (upto or farthest + k) - 1) + 1, k):
                            near, far = max(d, nearest), min(d + k - 1, farthest)
                            if near <= far:
                                core, hull = data[at - d : at - d - k + 1 + least], data[at - far : at - near + least]
                                rows.append((key, ctx, d, at - far, at - near, hashlib.blake2b(core, digest_size=16).digest(), hashlib.blake2b(hull, digest_size=16).digest()))
                    yield _batch(rows, types)

        return run

    found, todo, upto = [], None, None
    for k in blocks:
        rows = many.withColumn("todo", F.lit(None).cast("array<int>")) if todo is None else many.join(todo, ["key", "ctx"])
        made = written(rows.select("key", "ctx", "starts", "bytes", "todo").mapInArrow(level(k, upto), "key long, ctx long, block int, first int, last int, core binary, hull binary"), f"windows-{k}")
        cores = made.groupBy("core").agg(F.count("*").alias("n"), F.min(F.xxhash64("hull")).alias("x"), F.max(F.xxhash64("hull")).alias("y")).filter("n > 1").select("core", "n", (F.col("x") != F.col("y")).alias("mixed"))
        hulls = made.groupBy("hull").agg(F.count("*").alias("n"), F.min(F.struct("key", "ctx", "block")).alias("one")).filter("n > 1").select("hull", "n", "one")
        total = made.count()
        known = met(met(made, cores, "core", "n", total), hulls, "hull", "n", total, "left")
        # One block of each hull goes on with those that are left, which may equal a part of it.
        known = known.select("key", "ctx", "block", "first", "last", F.col("one").isNotNull().alias("all"), (F.col("one").isNull() | F.col("mixed") & (F.col("one") == F.struct("key", "ctx", "block"))).alias("on"))
        known = written(known, f"known-{k}")
        found.append(known.filter("all").select("key", "ctx", F.array(F.col("first"), F.col("last") + least).alias("r")))
        todo, upto = known.filter("on").groupBy("key", "ctx").agg(F.collect_list("block").alias("todo")), k
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("key", "ctx").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """id and h, which tell rows apart: the id or -1, and a hash of the text (another one where the id is null)."""
    doc_id, text = doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit(""))
    h = F.when(doc_id.isNull(), F.xxhash64(text, F.lit("no id"))).otherwise(F.xxhash64(text))
    return F.coalesce(doc_id, F.lit(-1)).alias("id"), h.alias("h")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), id and h."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row_key(F.col("doc_id"), F.col("text")))


def words_in(data: bytes) -> int:
    return sum(1 + len(part) // WORD_BYTES for part in data.split())


def remaining(data: bytes, flat: list[int] | None, words: int = 0) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left without the runs of `words` words or more, and these runs."""
    runs = merged(list(zip(flat[::2], flat[1::2], strict=True))) if flat else []
    runs = [(lo, hi) for lo, hi in runs if not words or words_in(data[lo:hi]) >= words]
    out, at = [], 0
    for lo, hi in runs:
        out.append(data[at:lo])
        at = hi
    return b"".join(out) + data[at:], runs


def without_repeats(docs: DataFrame, least: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """docs with the repeated bytes of their text removed where they run for `least` bytes and `words` words (and n_chars, if there, brought up to date); the other columns stay."""
    _, marks = spans(hashed(docs), least)
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text"), *row_key(F.col("doc_id"), F.col("text")))
    joined = own.join(marks, ["id", "h"], "left").select("row", "spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, flat in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.append(remaining(text.encode("utf-8", "surrogatepass"), flat, words)[0].decode("utf-8", "ignore") if text is not None and flat else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    out = joined.mapInArrow(run, joined.drop("spans").schema)
    value = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[(value[c] if c in value else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings (n_bytes is the whole input's length)."""
    docs = hashed(table(spark, sf_dir, "documents"))
    held, marks = spans(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        for batch in batches:
            rows = []
            for doc_id, text, flat in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, runs = remaining(data, flat)
                rows.append((doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            yield _batch(rows, types)

    some = held.select("doc_id", "id", "h", "text").join(marks, ["id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    # Texts without a candidate never leave the JVM; only their digests are joined.
    known = docs.select("doc_id", "id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return some.unionByName(known.join(held.select("id", "h"), ["id", "h"], "left_anti").drop("id", "h"))
