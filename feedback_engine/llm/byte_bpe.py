"""Byte-level BPE encoding and decoding without a regular expression.

Texts are split before the merges as public_tokenizers.PATTERN says, by arrays:
each code point has a class, each class is a function from states to states of a
small automaton, and these functions are composed. Composition is associative,
so a text's functions are composed in blocks side by side, the blocks' functions
by the same step again, and with the state at each block's start known the
blocks are run side by side once more, which gives the slices' first bytes. All
texts of a portion are one array; an end mark between them leads every state to
the start. Slices are merged pair by pair in order of rank, through a cache in
each worker. The byte at which each token begins is kept beside the ids and is
what decoding writes by.

Defined cases: null and empty texts have no ids; rows that repeat get the same
result; only the columns doc_id and text are read; an empty table gives an empty
one. A text longer than PORTION is cut before a blank that follows another
character, where slices begin whatever comes before; memory is bound by PORTION
and by the longest row.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import small_batches, table
from feedback_engine.llm.tokens import vocabulary

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text that are split at once.
PORTION = 1 << 20
#: Slices held in each of the two generations of a worker's cache, and the longest of them in bytes.
CACHE_SLICES, CACHED_BYTES = 400_000, 64
#: Longer slices, in bytes, are merged by a heap.
HEAPED = 100
#: Functions that are composed one after the other, side by side with those of other blocks.
BLOCK = 64

# Classes of code points. Of letters, those that end "'s", "'t", "'m", "'d" at once, those of "'re" and "'ve", and that of "'ll" are apart.
OTHER, LETTER, SHORT, RV, E, DOUBLE, NUMBER, APOSTROPHE, BLANK, SPACE, END = range(11)
LETTERS, SPACES = (LETTER, SHORT, RV, E, DOUBLE), (BLANK, SPACE)
# States: what the last characters are. AFTER: a contraction is complete; RV_ and L_: an apostrophe and its first letter; blanks and other white space, one or many.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTE, RV_, L_, AFTER, BLANK_1, BLANK_N, SPACE_1, SPACE_N = range(12)
STATES = 16
#: A slice begins here, or one character before.
HERE, BACK = 1, 2
#: Between texts; no text holds half a surrogate pair.
MARK = "\ud800"


def step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and where slices begin."""
    if state == QUOTE and kind in (SHORT, RV, DOUBLE):
        return {SHORT: AFTER, RV: RV_, DOUBLE: L_}[kind], 0
    if (state, kind) in ((RV_, E), (L_, DOUBLE)):
        return AFTER, 0
    back = BACK if state in (RV_, L_) else 0  # no contraction, so its letter began a slice
    if kind == END:
        return START, HERE | back
    many = state in (BLANK_N, SPACE_N)
    if kind in SPACES:
        if state in (BLANK_1, SPACE_1) or many:
            return (BLANK_N if kind == BLANK else SPACE_N), 0
        return (BLANK_1 if kind == BLANK else SPACE_1), HERE | back
    run = IN_LETTERS if kind in LETTERS else IN_NUMBERS if kind == NUMBER else IN_OTHERS
    if state in (BLANK_1, BLANK_N):  # the last blank goes with what follows
        return run, BACK if many else 0
    if {RV_: IN_LETTERS, L_: IN_LETTERS, QUOTE: IN_OTHERS}.get(state, state) == run:
        return run, back
    return (QUOTE if kind == APOSTROPHE else run), HERE | back | (BACK if many else 0)


#: By class * STATES + state.
NEXT, BEGINS = (bytes(step(i % STATES, i // STATES)[k] if i % STATES < 12 and i // STATES <= END else 0 for i in range(256)) for k in (0, 1))
IDENTITY = np.arange(STATES, dtype=np.uint8)


@cache
def classes() -> np.ndarray:
    """The class of every code point, by the library's own Unicode tables."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    bytewise = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytewise, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    for letters, kind in (("stmd", SHORT), ("rv", RV), ("e", E), ("l", DOUBLE), ("'", APOSTROPHE), (" ", BLANK), (MARK, END)):
        out[[ord(c) for c in letters]] = kind
    return out


def stepped(kinds: np.ndarray, states: np.ndarray, by: bytes = NEXT) -> np.ndarray:
    """A table's values for classes and states of the same shape."""
    return np.frombuffer((kinds * np.uint8(STATES) | states).tobytes().translate(by), np.uint8).reshape(states.shape)


def entered(functions: np.ndarray, first: int = START) -> np.ndarray:
    """The state in which each of a row of functions is entered: blocks composed side by side, and the blocks' functions likewise."""
    n = len(functions)
    if n <= BLOCK:
        out = [first]
        for f in functions[:-1]:
            out.append(int(f[out[-1]]))
        return np.array(out[:n], np.uint8)
    blocks = -(-n // BLOCK)
    rows = np.concatenate([functions, np.broadcast_to(IDENTITY, (blocks * BLOCK - n, STATES))]).reshape(blocks, BLOCK, STATES)
    whole = np.broadcast_to(IDENTITY, (blocks, STATES))
    for k in range(BLOCK):
        whole = np.take_along_axis(rows[:, k], whole, 1)
    at, out, each = entered(whole, first), np.empty((blocks, BLOCK), np.uint8), np.arange(blocks)
    for k in range(BLOCK):
        out[:, k] = at
        at = rows[each, k, at]
    return out.ravel()[:n]


def begins(kinds: np.ndarray) -> np.ndarray:
    """The places where slices begin, end marks among them; the last class is an end mark."""
    n = len(kinds)
    blocks = -(-n // BLOCK)
    columns = np.ascontiguousarray(np.concatenate([kinds, np.full(blocks * BLOCK - n, END, np.uint8)]).reshape(blocks, BLOCK).T)
    functions = np.broadcast_to(IDENTITY, (blocks, STATES))
    for column in columns:
        functions = stepped(column[:, None], functions)
    at, found = entered(functions), np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        found[k] = stepped(column, at, BEGINS)
        at = stepped(column, at)
    found = found.T.ravel()[:n]
    here = (found & HERE).astype(bool)
    here[:-1] |= found[1:] >= BACK
    return np.flatnonzero(here)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the pair of the smallest rank, the first of those, is merged until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > HEAPED:
        return merged_by_heap(piece, ranks)
    get, none = ranks.get, 1 << 29
    ends = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)] + [none]
    while (least := min(pairs)) < none:
        i = pairs.index(least)
        del ends[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(piece[ends[i - 1] : ends[i + 1]], none)
        if i + 2 < len(ends):
            pairs[i] = get(piece[ends[i] : ends[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


def merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long slice: pairs wait in a heap, so time grows as n log n."""
    n = len(piece)
    after, before, first = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not first[i] or j >= n or after[j] != end:  # one of the two has grown since
            continue
        first[j], after[i] = 0, end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end])) is not None:
            heappush(heap, (r, before[i], end))
    return [ranks[piece[i : after[i]]] for i in range(n) if first[i]]


class Slices(dict):
    """Ids of slices as little-endian bytes; two generations, so frequent slices outlive a full cache."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        mark = MARK.encode("utf-8", "surrogatepass")
        super().__init__({mark: b""})
        self.ranks, self.old, self.mark = ranks, {}, mark
        self.four = [i.to_bytes(4, "little") for i in range(max(ranks.values(), default=-1) + 1)]

    def __missing__(self, piece: bytes) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = b"".join([self.four[i] for i in merged(piece, self.ranks)])
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE_SLICES:
                self.old = dict(self)
                self.clear()
                self[self.mark] = b""
            self[piece] = out
        return out


def cut(text: str, most: int) -> list[str]:
    """A long text in parts of about `most` characters, cut before blanks that follow a character that is no white space."""
    parts, at = [], 0
    while len(text) - at > most:
        end = text.find(" ", at + most)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


class Coder:
    def __init__(self, ranks: dict[bytes, int], kinds: np.ndarray) -> None:
        self.slices, self.kinds = Slices(ranks), kinds
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def sliced(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The slices of all texts, each text's followed by an end mark, and the marks' places among them."""
        joined = MARK.join([*texts, ""])
        data = joined.encode("utf-8", "surrogatepass")
        kinds = self.kinds[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = begins(kinds)
        marks = np.searchsorted(starts, np.flatnonzero(kinds == END))
        byte = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts].tolist()
        return [data[a:b] for a, b in zip(byte, [*byte[1:], len(data)], strict=True)], marks

    def portion(self, texts: list[str]) -> list[bytes]:
        pieces, marks = self.sliced(texts)
        ids = list(map(self.slices.__getitem__, pieces))
        return [b"".join(ids[a:b]) for a, b in zip([0, *marks[:-1].tolist()], marks.tolist(), strict=True)]

    def encode(self, texts: list[str], most: int = PORTION) -> list[bytes]:
        """Ids of each text; texts are split together up to `most` characters, longer ones in parts."""
        out: list[bytes] = []
        waiting: list[str] = []
        held = 0
        for text in texts:
            if held + len(text) > most and waiting:
                out += self.portion(waiting)
                waiting, held = [], 0
            if len(text) > most:
                out.append(b"".join([self.portion([x])[0] for x in cut(text, most)]))
            else:
                waiting.append(text)
                held += len(text)
        return out + (self.portion(waiting) if waiting else [])

    def offsets(self, ids: bytes) -> bytes:
        """The byte at which each token begins."""
        size = self.size[np.frombuffer(ids, "<u4")]
        return (np.cumsum(size) - size).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        """The bytes of tokens, each written at its offset; a run of a document's tokens gives the bytes from its first offset on."""
        tokens, at = np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        if not len(tokens):
            return b""
        size = self.size[tokens]
        out = np.zeros(int(at[-1] - at[0] + size[-1]), np.uint8)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at - at[0], size) + within] = self.letters[np.repeat(self.first[tokens], size) + within]
        return out.tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


_made: dict[str, Coder] = {}


def coder(path: str | None = None, runs: tuple[np.ndarray, np.ndarray] | None = None) -> Coder:
    """Made once in each process; runs: classes as kind_runs() gives them."""
    path = path or vocabulary(RANKS)
    if path not in _made:
        _made[path] = Coder(read_ranks(path), classes() if runs is None else np.repeat(*runs))
    return _made[path]


def kind_runs() -> tuple[np.ndarray, np.ndarray]:
    """classes() as values and lengths of runs, some kilobytes that travel with a task."""
    kinds = classes()
    at = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    return kinds[at[:-1]], np.diff(at)


def by_batch(df: DataFrame, columns: list[str], f: Callable[[pa.RecordBatch], list[tuple[str, pa.Array]]], added: str) -> DataFrame:
    """The first of `columns` as it is and the columns that f makes of each Arrow batch."""
    keep = columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[a for _, a in made]], names=[keep, *[n for n, _ in made]])

    rows = df.select(*columns)
    return rows.mapInArrow(run, f"`{keep}` {rows.schema[0].dataType.simpleString()}, {added}")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and offsets (little-endian unsigned 32-bit; the byte of the text at which each token begins) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    path, runs = path or vocabulary(RANKS), kind_runs()

    def run(batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
        c = coder(path, runs)
        ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
        return [("ids", pa.array(ids, pa.binary())), ("offsets", pa.array([c.offsets(x) for x in ids], pa.binary()))]

    return by_batch(docs.withColumn("text", F.col("text").cast("string")), ["doc_id", "text"], run, "ids binary, offsets binary")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens (key, ids, offsets) with the bytes that they stand for."""
    path, runs = path or vocabulary(RANKS), kind_runs()

    def run(batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
        c = coder(path, runs)
        rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        return [("ids", batch.column(1)), ("decoded", pa.array([c.decode(i, o) for i, o in rows], pa.binary()))]

    return by_batch(tokens, [tokens.columns[0], "ids", "offsets"], run, "ids binary, decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document: how many, their digest, and the digest of the bytes decoded from them."""
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
