"""Jaccard self-join on word n-grams by chosen paths.

A document is the set of its hashed n-grams; documents with equal sets are one
class, which is compared once. To find similar classes, every set grows a few
random trees: at each node it follows those of its n-grams whose hash, with the
path so far, is below a share of 1 / |set|. Similar sets choose the same paths,
since they share most n-grams; each set finds its paths alone. Classes that meet
in a small bucket are compared by brute force; a bucket that is too large is
split by the next n-gram of the path. The runs are repeated until a pair at the
threshold is missed with a probability below 1 - recall.

Buckets compare minhash sketches against leaders, so a group of m near copies
gives about m candidate links, not m * m. A bucket that is still large at the end
of its path is dealt into parts; each finds its leaders, and the leaders of all
parts are then compared in pairs of blocks, so no bucket is one task. A sketch of a small set says too little,
so small sets are compared by short fingerprints of all their n-grams instead.
Candidate links form components, and in these every pair is checked exactly by
its sets, in blocks of bounded size and bytes; pairs are counted where they are checked and
never emitted.

Result: a row for each document with its class (smallest id of the documents
connected to it by links) and its number of links (documents, copies included).

Defined cases: words are runs of non-blanks, as they are; a text of fewer words
than n is one n-gram; a text without words (null, empty) has no links and is its
own class; repeated rows link each other; null ids keep their row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import dropped, folder_of, mark, met, settled, small_batches, table, written

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
GROWTH = (2.0, 1.5, 1.5)  # expected branches at each level
SKETCH = 64
PART = 2048  # members of a bucket, or leaders, that one task compares
FEW = 64  # n-grams about which sets are compared by fingerprints, by sketches, or by both
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_SPLIT = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _OTHER
    return (x ^ x >> np.uint64(29)) * _FACTOR


def runs_for(recall: float, jaccard: float = NUMERATOR / DENOMINATOR) -> int:
    """Runs after which a pair at the threshold, of whatever sizes, has met in a deepest bucket with this probability."""
    # A branch is one of both sets if its n-gram is below growth / the larger size; the fewest are, jaccard of them, where one set holds the other.
    alive, shared = 1.0, jaccard
    for growth in reversed(GROWTH):
        alive = 1 - math.exp(-growth * shared * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def words_hashed(data: bytes) -> np.ndarray:
    """A hash for each word of a text."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _SPLIT)
        while end < len(data) and not _BLANK[data[end - 1]]:  # to the end of a word
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_BLANK[b]
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        if len(starts):
            place = np.arange(len(b)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(b)]))))
            power = np.multiply.accumulate(np.full(int(place.max()) + 2, _FACTOR, np.uint64))
            out.append(_mixed(np.add.reduceat(np.where(inside, _BYTE[b] * power[place], np.uint64(0)), starts)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's hashed n-grams."""
    words = words_hashed(data)
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total += words[j : len(words) - width + 1 + j] * np.uint64(pow(int(_OTHER), j + 1, 1 << 64))
    return np.unique(_mixed(total))


def sketch(own: np.ndarray) -> bytes:
    """One-permutation minhashes of a set, 8 bits each; empty bins borrow from the next."""
    h = _mixed(own ^ _SEEDS[255])
    bins = (h >> np.uint64(58)).astype(np.int64)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins, h & np.uint64((1 << 58) - 1))
    filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
    source = filled[np.searchsorted(filled, np.arange(SKETCH)) % len(filled)]
    return _mixed(least[source] + (np.arange(SKETCH) != source).astype(np.uint64) * np.uint64(77)).astype(np.uint8).tobytes()


def outline(own: np.ndarray, jaccard: float) -> bytes:
    """What buckets compare: 1 and 16-bit fingerprints of a small set, 2 and the sketch of a large one, 3 and both between; similar sets have one in common."""
    few, many = len(own) <= FEW / jaccard, len(own) >= FEW * jaccard
    prints = np.unique(np.maximum(_mixed(own ^ _SEEDS[254]) >> np.uint64(48), np.uint64(1))).astype(np.uint16).tobytes() if few else b""
    return bytes([few + 2 * many]) + (sketch(own) if many else b"") + prints


def paths(own: np.ndarray, runs: int) -> list[tuple[int, int, int]]:
    """The leaves of a set's trees as their paths' hashes at each level; 0 where a path has ended."""
    n, nodes = len(own), _SEEDS[:runs]
    history = np.zeros((runs, 0), np.uint64)
    leaves = []
    for growth in GROWTH:
        limit = np.uint64(min(growth / n, 1.0) * 0xFFFFFFFFFFFFFFFF) if growth < n else np.iinfo(np.uint64).max
        hit, token = np.nonzero(_mixed(own[None, :] ^ nodes[:, None]) <= limit)
        ended = np.setdiff1d(np.arange(len(nodes)), hit)
        if history.shape[1]:
            leaves += [(*r, *[0] * (3 - len(r))) for r in history[ended].tolist()]
        nodes = _mixed(nodes[hit] * _FACTOR + own[token])
        history = np.column_stack([history[hit], nodes])
        if not len(nodes):
            break
    leaves += [tuple(r) for r in history.tolist() if history.shape[1] == 3]
    return leaves


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def class_of(own: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


TREES = "array<struct<p1:long,kids:array<struct<p2:long,p3s:array<long>>>>>"
_TREES = pa.list_(pa.struct([("p1", pa.int64()), ("kids", pa.list_(pa.struct([("p2", pa.int64()), ("p3s", pa.list_(pa.int64()))])))]))


def trees(own: np.ndarray, runs: int) -> list[dict]:
    """The paths of a set, nested by level."""
    out: dict[int, dict[int, list[int]]] = {}
    for a, b, c in paths(own, runs):
        kids = out.setdefault(_signed(a), {})
        if b:
            grand = kids.setdefault(_signed(b), [])
            if c:
                grand.append(_signed(c))
    return [{"p1": a, "kids": [{"p2": b, "p3s": c} for b, c in kids.items()]} for a, kids in out.items()]


def members(docs: DataFrame, runs: int, width: int, jaccard: float) -> DataFrame:
    """doc_id, h, c1, c2 (its class), n, sketch, trees for docs (doc_id, text, h); the last two once per class and task."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("trees", _TREES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(low, 1000), []
                for doc_id, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    own = shingles(text.as_buffer().to_pybytes(), width)
                    c = class_of(own)
                    if not len(own) or c in seen:
                        rows.append((doc_id, h, *c, len(own), None, None))
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    rows.append((doc_id, h, *c, len(own), outline(own, jaccard), trees(own, runs)))
                yield _batch(rows, schema)

    return docs.select("doc_id", "h", "text").mapInArrow(run, f"doc_id long, h long, c1 long, c2 long, n int, sketch binary, trees {TREES}")


def leader_links(ids: list[int], rows: list[bytes], same: float, near: float, near_few: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect what a bucket holds in common, fewer than it has members, and the places of its leaders.

    A member is compared with the leaders by what both outlines have; if it is not
    the same as one in all that its own has, it becomes one. A link is made where it
    connects two parts not yet connected.
    """
    few, many = [r[0] & 1 > 0 for r in rows], np.array([r[0] & 2 > 0 for r in rows])
    prints = [np.frombuffer(r, np.uint16, offset=1 + SKETCH * int(m)) if f else np.zeros(0, np.uint16) for r, f, m in zip(rows, few, many, strict=True)]
    # Of the leaders: sketches, fingerprints filled up with 0, which none has, and how many.
    sketches, has = np.zeros((len(rows), SKETCH), np.uint8), np.zeros(len(rows), bool)
    table_, size = np.zeros((len(rows), max(map(len, prints))), np.uint16), np.zeros(len(rows), np.int64)
    flags = np.zeros(1 << 16, bool) if any(few) else None
    leaders, out = [], []
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        at = len(leaders)
        own = np.frombuffer(rows[i], np.uint8, SKETCH, 1) if many[i] else None
        if leaders:
            close, equal = np.zeros(at, bool), np.ones(at, bool)
            if many[i]:
                share = (sketches[:at] == own).mean(1) * has[:at]
                close, equal = share >= near, share >= same
            if few[i]:
                flags[prints[i]] = True
                inter = flags[table_[:at]].sum(1)
                flags[prints[i]] = False
                share = inter / (size[:at] + len(prints[i]) - inter)
                close, equal = close | (share >= near_few), equal & (share >= same)
            for j in np.flatnonzero(close).tolist():
                a, b = top(i), top(leaders[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[leaders[j]]))
            if equal.any():
                continue
        if many[i]:
            sketches[at], has[at] = own, True
        table_[at, : len(prints[i])], size[at] = prints[i], len(prints[i])
        leaders.append(i)
    return out, leaders


def candidate_links(classes: DataFrame, bucket: int, jaccard: float, part: int = PART) -> DataFrame:
    """(a, b) of first halves of class ids that met in a bucket and look similar."""

    def counted(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        sizes = written(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), name)
        return sizes, sizes.agg(F.sum("n")).first()[0] or 0

    first = classes.select("c1", "sketch", F.explode("trees.p1").alias("k"))
    sizes, total = counted(first, "sizes-1")
    small = met(first, sizes, "k", "n", total, only=F.col("n") <= bucket)
    deep = met(classes.select("c1", "sketch", F.explode("trees").alias("t")).select("c1", "sketch", F.col("t.p1").alias("k"), "t.kids"), sizes, "k", "n", total, only=F.col("n") > bucket)
    deep = written(deep.select("c1", "sketch", F.explode("kids").alias("t")).select("c1", "sketch", F.col("t.p2").alias("k"), "t.p3s"), "deep")
    sizes, total = counted(deep, "sizes-2")
    middle = met(deep.select("c1", "sketch", "k"), sizes, "k", "n", total, only=F.col("n") <= bucket)
    third = met(deep, sizes, "k", "n", total, only=F.col("n") > bucket)
    third = written(third.select("c1", "sketch", F.explode("p3s").alias("k")), "third")
    sizes, total = counted(third, "sizes-3")
    # The rare bucket that is large at the end of its path is dealt into parts.
    sizes = written(sizes.filter(F.col("n") > part).withColumn("parts", F.ceil(F.col("n") / part).cast("int")), "large")
    large = not sizes.isEmpty()
    third = met(third, sizes, "k", "n", total, "left") if large else third.withColumn("parts", F.lit(None).cast("int"))
    # A pair at the threshold and a leader that is `same` as one of it are this far apart at most; the leaders of both, by `same` once more.
    error = 3 * math.sqrt(0.25 / SKETCH)
    same = 0.9
    slack = 1 - same + error / 3
    near, far = (max(0.05, jaccard - hops * slack - error) for hops in (1, 2))
    near_few, far_few = (max(0.05, jaccard - hops * (1 - same) - 0.02) for hops in (1, 2))  # fingerprints are exact but for rare equal ones

    def compare(near: float, near_few: float):
        """From rows (c1, sketch, key columns, flag) sorted by key: links (a, b), and where the flag is set the leaders (k, c1, sketch)."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("sketch", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, rows, flag = None, [], [], False

            def done() -> list[tuple]:
                if len(ids) < 2 and not flag:
                    return []
                links, leaders = leader_links(ids, rows, same, near, near_few)
                return [(a, b, None, None) for a, b in links if a != b] + [(ids[i], ids[i], key[0], rows[i]) for i in leaders if flag]

            for batch in batches:
                out: list[tuple] = []
                for c, s, *k, f in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                    if k != key:
                        out += done()
                        key, ids, rows, flag = k, [], [], f
                    ids.append(c)
                    rows.append(s)
                yield _batch(out, schema)
            yield _batch(done(), schema)

        return run

    own = F.coalesce(F.pmod(F.xxhash64("c1"), F.col("parts")), F.lit(0)).cast("int")
    rows = small.select("c1", "sketch", "k", F.lit(0).alias("part"), F.lit(False).alias("f")).unionByName(middle.select("c1", "sketch", "k", F.lit(0).alias("part"), F.lit(False).alias("f")))
    rows = rows.unionByName(third.select("c1", "sketch", "k", own.alias("part"), F.col("parts").isNotNull().alias("f")))
    links = rows.repartition(F.col("k"), F.col("part")).sortWithinPartitions("k", "part", "c1").mapInArrow(compare(near, near_few), "a long, b long, k long, sketch binary")
    if not large:
        return links.select("a", "b")
    links = written(links, "bucket-links")
    leaders = links.filter("k is not null").select(F.col("a").alias("c1"), "sketch", "k")
    sizes = written(leaders.groupBy("k").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int")), "leaders")
    blocks = met(leaders, sizes, "k", "n", sizes.agg(F.sum("n")).first()[0]).withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("c1", "sketch", "k", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.lit(False).alias("f"))
    across = blocks.repartition(F.col("k"), F.col("x"), F.col("y")).sortWithinPartitions("k", "x", "y", "c1").mapInArrow(compare(far, far_few), "a long, b long, k long, sketch binary")
    return links.filter("k is null").select("a", "b").unionByName(across.select("a", "b"))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): the smallest node of each node's component, by hooking to smaller labels and jumping pointers."""
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    folders: list[str] = []
    n_edges = edges.count()
    for _ in range(rounds):
        # Each node of an edge links to the smallest neighbour; so do the neighbours among themselves, through it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # A star's centre has as many edges as the star has leaves; they are dealt out.
        linked = met(both, smallest, "a", "n", 2 * n_edges).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = written(linked.unionByName(smallest.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        folders.append(folder_of(edges))
        stats = new.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        # Stars: every node has one link, to one that has none itself.
        over = stats["n"] == stats["nodes"] and not new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges, n_edges = new, stats["n"]
        if over:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if folders:
        dropped(spark, *[f for f in folders if f])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _links_of(left: list[tuple], right: list[tuple] | None, ratio: tuple[int, int]) -> np.ndarray:
    """Which sets of left and right (or of left among themselves) are similar; rows end with (n, set bytes)."""
    both = left + (right or [])
    sets = [np.frombuffer(r[-1], np.uint64) for r in both]
    size = np.array([len(x) for x in sets])
    tokens, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    half = len(left)
    shared = np.zeros((half, len(both) - (half if right is not None else 0)), np.float32)
    step = 4096
    bounds = np.searchsorted(index, np.arange(0, len(tokens) + step, step))
    for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        has = np.zeros((len(both), step), np.float32)
        has[owner[lo:hi], index[lo:hi] - i * step] = 1
        shared += has[:half] @ (has[half:] if right is not None else has).T
    inter = shared.astype(np.int64)
    other = size[half:] if right is not None else size
    found = ratio[1] * inter >= ratio[0] * (size[:half, None] + other[None, :] - inter)
    if right is None:
        np.fill_diagonal(found, False)
    return found


def exact_links(sets: DataFrame, ratio: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """From (label, blocks, mine, c1, c2, copies, own) of classes in candidate components, each dealt into blocks: (c1, c2, links) in documents, and star links (a, b) of exact components."""
    # A class meets every block of its component once; a pair of blocks is one group.
    meets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("label", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "c1", "c2", "copies", "own")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("links", pa.int64())])

    def star(rows: list[tuple], found: np.ndarray, left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
        root = list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(found), strict=True):
            a, b = top(left[i]), top(right[j])
            if a != b:
                root[max(a, b)] = min(a, b)
        smallest: dict[int, int] = {}
        for i, r in enumerate(rows):
            smallest[top(i)] = min(r[1], smallest.get(top(i), r[1]))
        return ((r[1], smallest[top(i)]) for i, r in enumerate(rows))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, seen = None, [], set()

        def done() -> list[tuple]:
            if len(rows) < 2:
                return []
            _, x, y = key
            left = [i for i, r in enumerate(rows) if r[0] == x]
            right = [i for i, r in enumerate(rows) if r[0] == y] if x != y else left
            if not left or not right:
                return []
            found = _links_of([rows[i] for i in left], [rows[i] for i in right] if x != y else None, ratio)
            copies = np.array([r[3] for r in rows])
            links = np.zeros(len(rows), np.int64)
            links[left] += found @ copies[right]
            if x != y:
                links[right] += found.T @ copies[left]
            return [(a, b, r[1], r[2], int(n)) for (a, b), r, n in zip(star(rows, found, left, right), rows, links, strict=True) if n]

        for batch in batches:
            out: list[tuple] = []
            for *k, mine, c1, c2, copies, own in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if k != key:
                    out += done()
                    key, rows, seen = k, [], set()
                if (c1, c2) not in seen:  # rows that repeat id and text bring their class again
                    seen.add((c1, c2))
                    rows.append((mine, c1, c2, copies, own))
            yield _batch(out, schema)
        yield _batch(done(), schema)

    found = written(meets.repartition(F.col("label"), F.col("x"), F.col("y")).sortWithinPartitions("label", "x", "y").mapInArrow(check, "a long, b long, c1 long, c2 long, links long"), "links")
    return found.groupBy("c1", "c2").agg(F.sum("links").alias("links")), found.select("a", "b")


def joined(docs: DataFrame, recall: float = 0.999, width: int = WIDTH, ratio: tuple[int, int] = (NUMERATOR, DENOMINATOR), bucket: int = 64, block: int = 1024, block_bytes: int = 8 << 20, part: int = PART) -> DataFrame:
    """doc_id, h, class_id, n_links for docs (doc_id, text); a written table."""
    small_batches(docs.sparkSession)
    since, jaccard = mark(), ratio[0] / ratio[1]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = written(members(docs, runs_for(recall, jaccard), width, jaccard), "members")
    some = rows.filter("n > 0")
    # One row for each class; copies combine before they travel.
    classes = some.groupBy("c1", "c2").agg(
        F.count("*").alias("copies"), F.first("n").alias("n"), F.min("doc_id").alias("least"), F.first("sketch", ignorenulls=True).alias("sketch"), F.first("trees", ignorenulls=True).alias("trees"), F.min(F.struct("doc_id", "h")).alias("one")
    )
    classes = written(classes, "classes")
    near = components(candidate_links(classes.select("c1", "sketch", "trees"), bucket, jaccard, part))
    wanted = written(classes.select("c1", "c2", "copies", "n", "one.*").join(near.withColumnRenamed("node", "c1"), "c1"), "wanted")
    # Blocks of hash-dealt classes can be a little uneven; they stay near `block` sets and `block_bytes`.
    blocks = wanted.groupBy("label").agg(F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / block_bytes)).cast("int").alias("blocks"))
    dealt = met(wanted.drop("n"), blocks, "label", "m", wanted.count()).withColumn("mine", F.pmod(F.xxhash64("c1", "c2"), F.col("blocks")).cast("int"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int64()), ("blocks", pa.int32()), ("mine", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("copies", pa.int64()), ("own", pa.binary())])
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                cut = batch.slice(low, 1000)
                yield _batch([(*r, shingles(t.as_buffer().to_pybytes(), width).tobytes()) for *r, t in zip(*(cut.column(i).to_pylist() for i in range(6)), cut.column(6), strict=True)], schema)

    sets = docs.join(dealt, docs["doc_id"].eqNullSafe(dealt["doc_id"]) & (docs["h"] == dealt["h"])).select("label", "blocks", "mine", "c1", "c2", "copies", "text").mapInArrow(emit, "label long, blocks int, mine int, c1 long, c2 long, copies long, own binary")
    links, stars = exact_links(sets, ratio)
    labels = components(stars.filter("a <> b"))
    per_class = classes.select("c1", "c2", "copies", "least").join(links, ["c1", "c2"], "left").join(labels.withColumnRenamed("node", "c1"), "c1", "left")
    per_class = written(per_class.select("c1", "c2", "copies", "least", "label", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "verdicts")
    linked = per_class.filter("label is not null")
    names = linked.groupBy("label").agg(F.min("least").alias("class_id"), F.count("*").alias("m"))
    named = met(linked, names, "label", "m", linked.count()).select("c1", "c2", "copies", "class_id", "n_links")
    named = named.unionByName(per_class.filter("label is null").select("c1", "c2", "copies", F.col("least").alias("class_id"), "n_links"))
    each = met(some.select("doc_id", "h", "c1", "c2"), named, ["c1", "c2"], "copies", rows.count()).select("doc_id", "h", "class_id", "n_links")
    return settled(each.unionByName(rows.filter("n = 0").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))), "near-duplicates", since)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one with the smallest id (and, of repeated rows, one)."""
    found = joined(docs)
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "h").agg(F.max("n_links").alias("n"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = own.join(chosen, own["doc_id"].eqNullSafe(chosen["doc_id"]) & (own["h"] == chosen["h"]), "left_semi")
    # Rows that share id and text are copies of each other, so one stays.
    return kept.dropDuplicates(["doc_id", "h"]).select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


OP3_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
      FROM (SELECT r, w, unnest(range(1, CAST(greatest(len(w) - 4, least(len(w), 1)) AS BIGINT) + 1)) AS i FROM w)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2)
      JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, (SELECT min(o.doc_id) FROM reach JOIN w o ON o.r = reach.b WHERE reach.a = w.r) AS class_id,
       CAST((SELECT count(*) FROM e WHERE e.a = w.r) AS BIGINT) AS n_links FROM w
"""
