"""Token ids in a content-addressed store.

A rolling hash over a window of ids cuts each document's id stream where its
content says so; a chunk is stored once, under its digest, whatever documents
hold it. Files (parquet, in one folder):

  chunks/   digest (blake2b-128 of width and payload), width (bytes an id takes:
            2 if all of the chunk fit, else 4), payload: every distinct chunk once
  recipes/  kind=doc: part, row, doc_id, start (within the part), n_tokens, the
            digests in order, root; parts and rows in ascending doc_id order
            kind=part: for each part its number of ids and the Merkle root of
            its documents' roots

Reading checks every payload against its digest, every document's root against
its digests, and every part against its root. The checksum of a document comes
from its chunks' checksums (which are combined), so ids move once, when chunks
are gathered under their digests; afterwards only digests are shuffled.

Defined cases: a null text is empty, one end id; each row is a document of its
own (repeated rows share chunks; null ids come first); an empty table gives
empty files and an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_engine.llm import tokens
from feedback_engine.llm.common import HEAVY, dropped, new_folder, small_batches, table

#: WINDOW is a power of two and below LEAST.
LEAST, MEAN_BITS, MOST, WINDOW = 128, 9, 4096, 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def candidates(ids: np.ndarray) -> np.ndarray:
    """Places of an id stream after which the ids of the window before allow a cut."""
    own = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    own ^= own >> np.uint64(29)
    rolled, k = own, 1
    while k < WINDOW:  # sums over k ids become sums over 2 k
        wider = rolled.copy()
        wider[k:] += rolled[:-k] * np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
        rolled, k = wider, 2 * k
    return np.flatnonzero((rolled * _MULTIPLIER) >> np.uint64(64 - MEAN_BITS) == 0)


def ends(allowed: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids, none shorter than LEAST (but the last) or longer than MOST."""
    out, at = [], 0
    for i in allowed:
        while i + 1 - at > MOST:
            at += MOST
            out.append(at)
        if i + 1 - at >= LEAST and i + 1 < n:
            at = i + 1
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n]


def cuts(ids: np.ndarray) -> list[int]:
    return ends(candidates(ids).tolist(), len(ids))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def chunk_digest(width: int, payload: bytes) -> bytes:
    return digest(bytes([width]) + payload)


class Merkle:
    """Root of a sequence of leaves, with a stack as high as the tree."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            leaf, level = digest(b"\x01" + self.stack.pop()[1] + leaf), level + 1
        self.stack.append((level, leaf))

    def root(self) -> bytes:
        out = b""
        for _, x in reversed(self.stack):
            out = digest(b"\x01" + x + out) if out else x
        return out or digest(b"")


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


_POLY = 0xEDB88320
_shift: dict[int, int] = {}


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, in its reflected bit order."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc_joined(first: int, second: int, n: int) -> int:
    """crc32 of two byte strings put together, from theirs and the length of the second."""
    if n not in _shift:
        power, x, k = 1 << 31, 1 << 23, n  # x: by 8 bits
        while k:
            power = _times(power, x) if k & 1 else power
            x, k = _times(x, x), k >> 1
        if len(_shift) > 1 << 16:
            _shift.clear()
        _shift[n] = power
    return _times(_shift[n], first) ^ second


def chunked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of two kinds: documents (doc_id, n_tokens, digests, root) and chunks (digest, width, payload), each once per task."""
    small_batches(docs.sparkSession)
    path = path or tokens.vocabulary()
    schema = "doc_id long, n_tokens long, digests array<binary>, root binary, digest binary, width int, payload binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary()), ("digest", pa.binary()), ("width", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = tokens.encoder(path), set()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part, rows = batch.slice(low, 500), []
                data = [tokens.document_bytes(t, encode) for t in part.column(1).to_pylist()]
                # Documents are cut together: a window over two of them ends before either may be cut.
                ids, starts = np.frombuffer(b"".join(data), "<u4"), np.concatenate(([0], np.cumsum([len(d) // 4 for d in data], dtype=np.int64)))
                places = candidates(ids)
                first, places, starts = np.searchsorted(places, starts).tolist(), places.tolist(), starts.tolist()
                small = int(ids.max()) < 1 << 16
                short = ids.astype("<u2").tobytes() if small else b""
                for j, doc_id in enumerate(part.column(0).to_pylist()):
                    start, n = starts[j], starts[j + 1] - starts[j]
                    at, digests = start, []
                    for end in ends([p - start for p in places[first[j] : first[j + 1]]], n):
                        end += start
                        width = 2 if small or int(ids[at:end].max()) < 1 << 16 else 4
                        payload = short[2 * at : 2 * end] if small else ids[at:end].astype(f"<u{width}").tobytes()
                        key = chunk_digest(width, payload)
                        digests.append(key)
                        if key not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(key)
                            rows.append((None, None, None, None, key, width, payload))
                        at = end
                    rows.append((doc_id, n, digests, merkle_root(digests), None, None, None))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def write_store(docs: DataFrame, folder: str, path: str | None = None, part_docs: int = 20_000) -> None:
    """Encode docs (doc_id, text) into the files of folder."""
    spark = docs.sparkSession
    chunked(docs, path).write.option("compression", "snappy").parquet(f"{folder}/staged")  # read once more, then dropped
    staged = spark.read.parquet(f"{folder}/staged")

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for key in batch.column(0).to_pylist():
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new))

    # Copies within a task are gone already, so rows are dealt by digest as they are; a task remembers its own digests.
    dealt = staged.filter("digest is not null").select("digest", "width", "payload").repartition(F.col("digest"))
    dealt.mapInArrow(unique, "digest binary, width int, payload binary").write.option("compression", "zstd").parquet(f"{folder}/chunks")
    recipes = staged.filter("digests is not null").select("doc_id", "n_tokens", "digests", "root")
    parts = max(1, math.ceil(recipes.count() / part_docs))
    schema = "kind string, part int, row long, doc_id long, start long, n_tokens long, digests array<binary>, root binary"
    arrow = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        for batch in batches:
            sizes, roots = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for x in roots:
                tree.add(x)
            starts = start + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            n, start = len(sizes), int(starts[-1])
            ours = [pa.array(["doc"] * n), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(starts[:-1], pa.int64()), batch.column(1), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(ours, arrow, strict=True)], schema=arrow)
            row += n
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(("part", part, row, None, None, start, None, tree.root()), arrow, strict=True)], schema=arrow)

    # Rows that are equal in both are told apart by their place, so any number of them is divided.
    order = [F.asc_nulls_first("doc_id"), F.asc("digests"), F.asc("place")]
    ranged = recipes.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.drop("place").mapInArrow(number, schema).write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/recipes")
    dropped(spark, f"{folder}/staged")
    top_of(recipes_of(spark, folder)[1]).write.parquet(f"{folder}/top")


def top_of(parts: DataFrame) -> DataFrame:
    """One row over all parts: n_parts, n_docs, n_tokens and the root of their roots, in order. A part has one row, of up to part_docs documents, so one task reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sums = Merkle(), np.zeros(3, np.int64)
        for batch in batches:
            for part, n_docs, n_tokens, root in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tree.add(part.to_bytes(4, "little") + n_docs.to_bytes(8, "little") + n_tokens.to_bytes(8, "little") + root)
                sums += (1, n_docs, n_tokens)
        yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in sums.tolist()], pa.array([tree.root()], pa.binary())], names=["n_parts", "n_docs", "n_tokens", "root"])

    rows = parts.select("part", "n_docs", "part_tokens", "root").coalesce(1).sortWithinPartitions("part")
    return rows.mapInArrow(run, "n_parts long, n_docs long, n_tokens long, root binary")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """digest, n, crc of every stored chunk, from its payload, after checking that."""
    arrow = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, width, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chunk_digest(width, payload) != key:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
                data = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
                out.append((key, len(data) // 4, zlib.crc32(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 3, arrow, strict=True)], schema=arrow)

    chunks = spark.read.schema("digest binary, width int, payload binary").parquet(f"{folder}/chunks")
    return chunks.select("digest", "width", "payload").mapInArrow(run, "digest binary, n long, crc long")


def recipes_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents' recipes and the parts' manifest."""
    fields = "kind string, part int, row long, doc_id long, start long, n_tokens long, digests array<binary>, root binary"
    files = spark.read.schema(fields).parquet(f"{folder}/recipes")
    return files.filter("kind = 'doc'").drop("kind"), files.filter("kind = 'part'").select("part", F.col("row").alias("n_docs"), F.col("n_tokens").alias("part_tokens"), "root")


def verified(spark: SparkSession, folder: str) -> None:
    """Raise if the parts are not those that the top row stands for, or a part's root is not that of its documents' roots; these are checked where recipes are read."""
    docs, parts = recipes_of(spark, folder)
    top = spark.read.schema("n_parts long, n_docs long, n_tokens long, root binary").parquet(f"{folder}/top")
    if top.exceptAll(top_of(parts)).count() or top.count() != 1:
        raise ValueError("the parts do not match the top of the store")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part, n = Merkle(), None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "n", "seen"])
        for batch in batches:
            for own, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != part:
                    if part is not None:
                        yield done()
                    tree, part, n = Merkle(), own, 0
                tree.add(root)
                n += 1
        if part is not None:
            yield done()

    # Roots stream by in order; a task keeps a path of the tree.
    seen = docs.select("part", "root", "row").repartition(F.col("part")).sortWithinPartitions("part", "row").select("part", "root").mapInArrow(check, "part int, n long, seen binary")
    wrong = parts.join(seen, "part", "left").filter("n_docs > 0 and not (n <=> n_docs and seen <=> root)")
    if wrong.count():
        raise ValueError("a part does not match its root")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    docs, parts = recipes_of(spark, folder)
    before = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_tokens")).alias("before"))  # a row for each part
    use = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("pos", pa.int32()), ("digest", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, row, digests, root in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if merkle_root(digests) != root:
                    raise ValueError("a recipe does not match its root")
                out += [(part, row, i, d) for i, d in enumerate(digests)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, use, strict=True)], schema=use)

    uses = docs.select("part", "row", "digests", "root").mapInArrow(spread, "part int, row long, pos int, digest binary")
    # A chunk that many documents share (all empty texts are one) is dealt out; fewer than HEAVY have more than a share.
    share = max((docs.agg(F.sum(F.size("digests"))).first()[0] or 0) // HEAVY, 1000)
    heavy = docs.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > share)
    heavy = F.broadcast(heavy.select("digest", F.ceil(F.col("n") / share).cast("int").alias("parts")))
    uses = uses.join(heavy, "digest", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("part", "row", "pos"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = read_chunks(spark, folder).join(heavy, "digest", "left")
    copies = copies.withColumn("own", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("parts")
    found = uses.join(copies, ["digest", "own"], "left").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("c"))
    numbered = docs.drop("digests", "root").join(found, ["part", "row"], "left").join(F.broadcast(before), "part", "left")
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, start, n, sizes, sums in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if None in sizes:
                    raise ValueError("a chunk is missing")
                crc = sums[0]
                for size, x in zip(sizes[1:], sums[1:], strict=True):
                    crc = crc_joined(crc, x, 4 * size)
                if sum(sizes) != n:
                    raise ValueError("a document's chunks do not make up its length")
                out.append((doc_id, start, n, crc))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, arrow, strict=True)], schema=arrow)

    rows = numbered.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", F.col("c.n").alias("sizes"), F.col("c.crc").alias("sums"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array<long>) of every document, from the files."""
    docs, _ = recipes_of(spark, folder)
    chunks = spark.read.schema("digest binary, width int, payload binary").parquet(f"{folder}/chunks")
    uses = docs.select("part", "row", "doc_id", F.posexplode("digests").alias("pos", "digest")).join(chunks, "digest")
    whole = uses.groupBy("part", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "payload"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(c["payload"], f"<u{c['width']}").astype(np.int64) for c in chunks]) for chunks in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return whole.select("doc_id", "chunks").mapInArrow(run, "doc_id long, ids array<long>")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the store's files."""
    folder = new_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    verified(spark, folder)
    return read_store(spark, folder)
