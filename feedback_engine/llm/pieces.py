"""SentencePiece encoding and decoding by a max-plus scan.

Encoding is a best path through the lattice of pieces over a text: edges are
pieces, and a path's weight is the sum of its edges'. For a unigram model the
weights are the pieces' scores. For a BPE model they are 0, or minus infinity
where two pieces cannot stand side by side because merging in order of score
would join across them; one path is left, and it is the model's encoding.

A giant text is split into chunks wherever its length says. Across a chunk's end
lies one piece, the boundary state. Each chunk, alone, yields the matrix of best
weights from every state at its start to every state at its end; the matrices
are combined by the max-plus product, which is associative, as a tree: FAN of
them in a task, then FAN of the products, and back down for the states between
them; with the states at its ends known, each chunk is traced back alone. Where no piece of the vocabulary
spans two neighbouring characters all paths meet, so a chunk is solved once
between its first and last such place, whatever the state.

Texts below the giant size are one chunk of the same scan and need no shuffle. Parts between such
places are kept in a bounded cache in each worker.

Defined cases: null and empty texts have no pieces; characters without a piece
become byte pieces, or the unknown id if the model has none; U+2581 is a blank,
as in the library; repeated rows get the same result; an empty table gives an
empty one. Decoding joins pieces and drops the blank put in front. Models whose
normaliser changes more than blanks are refused.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import small_batches, table, written
from feedback_engine.llm.tokens import vocabulary

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
GIANT, CHUNK, FAN = 65_536, 32_768, 64
NEVER = float("-inf")
#: Parts held in each of the two generations of a worker's cache.
CACHE_PARTS = 250_000
UNIGRAM, BPE = 1, 2
State = tuple[int, int]  # a piece across a boundary: characters before and after it


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    def __init__(self, data: bytes) -> None:
        self.text: list[str] = []
        self.score: list[float] = []
        kinds: list[int] = []
        self.kind, self.prefix = UNIGRAM, True
        normal: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece[1].decode())
                self.score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, 1))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(fields(value))
        if self.kind not in (UNIGRAM, BPE) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or any(k in (4, 5) for k in kinds):
            raise ValueError("only unigram and BPE models without user-defined pieces and with an identity normaliser that keeps blanks")
        self.prefix = bool(normal.get(3, 1))
        self.unknown = kinds.index(2)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == 6}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == 1}
        self.longest = max(map(len, self.ids), default=1)
        self.endings = {t[i:] for t in self.ids for i in range(len(t))}
        self.joined = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        order = sorted(self.ids, key=lambda t: (-self.score[self.ids[t]], self.ids[t]))
        self.rank = {t: i for i, t in enumerate(order)}
        scores = [self.score[self.ids[t]] for t in order]
        self.tied = {order[i] for i in range(len(order)) if len(order[i]) > 1 and (i and scores[i] == scores[i - 1] or i + 1 < len(order) and scores[i] == scores[i + 1])}
        self.unknown_score = min(scores, default=0.0) - 10
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """A short text merged pair by pair in order of score, then place; and the last pair."""
        parts, last = list(text), None
        while True:
            best = None
            for i in range(len(parts) - 1):
                t = parts[i] + parts[i + 1]
                if t in self.ids and (best is None or self.score[self.ids[t]] > best[0]):
                    best = (self.score[self.ids[t]], i)
            if best is None:
                return parts, last
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The pair whose merge makes the piece; None if merging never makes it."""
        try:
            return self.splits[piece]
        except KeyError:
            parts, last = self.merged(piece)
            self.splits[piece] = last if parts == [piece] else None
            return self.splits[piece]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether BPE leaves a and b side by side."""
        if (a, b) not in self.fits:
            if len(self.fits) > 300_000:
                self.fits.clear()
            self.fits[a, b] = self._neighbours(a, b)
        return self.fits[a, b]

    def _neighbours(self, a: str, b: str) -> bool:
        if len(a) > 1 and self.split(a) is None or len(b) > 1 and self.split(b) is None:
            return False
        if any(BLANK * 2 in x or x in self.tied for x in (a, b, a[-1] + b[0])):
            return self.merged(a + b)[0] == [a, b]
        limit = len(self.rank) + 1
        while True:
            over = self.rank.get(a + b)
            if over is not None and over < limit:
                return False
            of_a, of_b = self.rank[a] if len(a) > 1 else -1, self.rank[b] if len(b) > 1 else -1
            if of_a > of_b:
                limit, a = of_a, self.split(a)[1]
            elif of_b == -1:
                return True
            else:
                limit, b = of_b + 1, self.split(b)[0]

    def table(self, text: str, before: str | None, at: int = 0) -> list[tuple[float, int] | None]:
        """For each end in text[at:], the best weight of a path that ends there and where its last piece starts. before: the piece that ends at `at`, if paths must go with it."""
        best: list[tuple[float, int] | None] = [None] * (len(text) + 1)
        last: list[str | None] = [None] * (len(text) + 1)
        best[at], last[at] = (0.0, -1), before
        bpe, longest, ids, endings, fits = self.kind == BPE, self.longest, self.ids, self.endings, self.fits
        for end in range(at + 1, len(text) + 1):
            for start in range(end - 1, max(at, end - longest) - 1, -1):
                piece = text[start:end]
                if piece not in ids and end - start > 1:
                    if piece in endings:
                        continue
                    break
                if best[start] is None:
                    continue
                if bpe:  # one piece at most can end at each place
                    left = last[start]
                    if left is None:
                        if end - start > 1 and self.split(piece) is None:
                            continue
                    else:  # pieces that merging never makes have no neighbours
                        fit = fits.get((left, piece))
                        if not (self.neighbours(left, piece) if fit is None else fit):
                            continue
                    best[end], last[end] = (0.0, start), piece
                    break
                weight = best[start][0] + (self.score[ids[piece]] if piece in ids else self.unknown_score)
                if best[end] is None or weight >= best[end][0]:
                    best[end], last[end] = (weight, start), piece
        return best

    def traced(self, text: str, best: list[tuple[float, int] | None], end: int, at: int = 0) -> list[str]:
        out = []
        while end > at:
            if best[end] is None:
                raise ValueError("no path")
            start = best[end][1]
            out.append(text[start:end])
            end = start
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def meeting(self, text: str, low: int, high: int, step: int) -> int | None:
        """The first place from low to high (or back) that no piece spans."""
        for i in range(low, high, step):
            if 0 < i < len(text) and text[i - 1 : i + 1] not in self.joined:
                return i
        return None


class BlankWords(dict):
    """Ids of words that follow one blank, by word; two generations."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            shown = BLANK + word
            out = self.encoder.part(shown) if word.isascii() and word.isalpha() else self.encoder.word(shown)
        if len(word) <= 64:
            if len(self) >= CACHE_PARTS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Encoder:
    def __init__(self, data: bytes) -> None:
        self.v, self.young, self.old = Vocabulary(data), {}, {}
        self.four = [i.to_bytes(4, "little") for i in range(len(self.v.text))]
        self.words = BlankWords(self)

    def part(self, text: str) -> bytes:
        """Ids of a text between two meeting places."""
        out = self.young.get(text)
        if out is None:
            out = self.old.get(text)
            if out is None:
                pieces = self.v.traced(text, self.v.table(text, None), len(text))
                out = b"".join([self.four[i] for i in self.v.ids_of(pieces)])
            if len(text) <= 64:
                self.keep(text, out)
        return out

    def keep(self, text: str, out: bytes) -> None:
        if len(self.young) >= CACHE_PARTS:
            self.old, self.young = self.young, {}
        self.young[text] = out

    def word(self, text: str) -> bytes:
        joined, at, parts = self.v.joined, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joined:
                parts.append(self.part(text[at:i]))
                at = i
        if not at:
            return self.part(text)
        parts.append(self.part(text[at:]))
        return b"".join(parts)

    def inside(self, text: str) -> bytes:
        """Ids of a text that starts and ends at meeting places; blanks are BLANK."""
        if self.joined_blanks():
            return self.word(text)
        get, out, run = self.young.get, [], 0
        words = text.split(BLANK)
        if words[0]:
            out.append(self.young.get(words[0]) or self.word(words[0]))
        for w in words[1:]:
            run += 1
            if w:
                w = BLANK * run + w
                out.append(get(w) or self.old.get(w) or self.word(w))
                run, get = 0, self.young.get
        if run:
            out.append(self.word(BLANK * run))
        return b"".join(out)

    def joined_blanks(self) -> list[str]:
        """Pairs of a character and a blank after it that some piece spans."""
        if not hasattr(self, "_blanks"):
            self._blanks = [t for t in self.v.joined if t[1] == BLANK and t[0] != BLANK]
        return self._blanks

    # --- chunks ---

    def states(self, text: str, at: int) -> list[State]:
        """Pieces that hold the character before `at` and may end after it."""
        if at == 0:
            return [(0, 0)]
        out = []
        for start in range(at - 1, max(-1, at - self.v.longest - 1), -1):
            for end in range(at, min(len(text), start + self.v.longest) + 1):
                if end - start == 1 or text[start:end] in self.v.ids:
                    out.append((at - start, end - at))
        return out

    def weight(self, piece: str) -> float:
        return 0.0 if self.v.kind == BPE else self.v.score[self.v.ids[piece]] if piece in self.v.ids else self.v.unknown_score

    def ending(self, text: str, best: list, at: int, stop: int, out: State, before: str | None) -> float:
        """Weight of the best path from `at` whose last piece is the state `out` at stop."""
        start, end = stop - out[0], stop + out[1]
        if start < at or best[start] is None:
            return NEVER
        piece = text[start:end]
        last = before if start == at else text[best[start][1] : start]
        if self.v.kind == BPE and (len(piece) > 1 and self.v.split(piece) is None or last is not None and not self.v.neighbours(last, piece)):
            return NEVER
        return best[start][0] + self.weight(piece)

    def matrix(self, text: str, low: int, high: int) -> dict[tuple[State, State], float]:
        """Best weights from each state at low to each state at high; text has context on both sides."""
        found: dict[tuple[State, State], float] = {}
        ends = self.states(text, high)
        first = self.v.meeting(text, low + self.v.longest, high - 2 * self.v.longest, 1)
        last = self.v.meeting(text, high - self.v.longest, (first or high) + 1, -1) if first else None
        middle, tail = 0.0, None
        if first and last:
            tail = self.v.table(text[: high + self.v.longest], None, last)
            if self.v.kind == UNIGRAM:
                middle = self.v.table(text[:last], None, first)[last][0]
        for state in self.states(text, low):
            begin = low + state[1]
            before = text[low - state[0] : begin] if state != (0, 0) else None
            if before is not None and len(before) > 1 and self.v.kind == BPE and self.v.split(before) is None:
                continue
            if tail is not None:
                head = self.v.table(text[:first], before, begin)[first]
                for e in ends:
                    w = NEVER if head is None else head[0] + middle + self.ending(text, tail, last, high, e, None)
                    if w > NEVER:
                        found[state, e] = w
            else:
                best = self.v.table(text[: high + self.v.longest], before, begin)
                for e in ends:
                    w = self.ending(text, best, begin, high, e, before)
                    if e[0] > high - low and (high - e[0], high + e[1]) == (low - state[0], begin):
                        w = 0.0  # one piece over the whole chunk
                    if w > NEVER:
                        found[state, e] = w
        return found

    def backtrace(self, text: str, low: int, high: int, into: State, out: State) -> bytes:
        """Ids of the pieces after the state at low, up to and with the state at high."""
        begin, end = low + into[1], high + out[1]
        before = text[low - into[0] : begin] if into != (0, 0) else None
        if (high - out[0], end) == (low - into[0], begin):
            return b""
        first = self.v.meeting(text, low + self.v.longest, high - 2 * self.v.longest, 1)
        last = self.v.meeting(text, high - self.v.longest, (first or high) + 1, -1) if first else None
        as_bytes = lambda pieces: np.array(self.v.ids_of(pieces), "<u4").tobytes()
        ended = high - out[0]
        if first and last:
            head = self.v.traced(text, self.v.table(text[:first], before, begin), first, begin)
            tail = self.v.traced(text, self.v.table(text[:ended], None, last), ended, last)
            return as_bytes(head) + self.inside(text[first:last]) + as_bytes([*tail, text[ended:end]])
        pieces = self.v.traced(text, self.v.table(text[:ended], before, begin), ended, begin)
        return as_bytes([*pieces, text[ended:end]])

    def shown(self, text: str) -> str:
        return (BLANK * self.v.prefix + text.replace(" ", BLANK)) if text else ""

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.v.prefix and "  " not in text and text[0] != " " and text[-1] != " " and BLANK not in text and not self.joined_blanks():
            return b"".join(map(self.words.__getitem__, text.split(" ")))  # each word follows one blank
        return self.inside(self.shown(text))

    def decode(self, ids: bytes) -> str:
        if not hasattr(self, "_bytes"):
            own = set(self.v.bytes.values())
            self._bytes = [bytes([int(t[3:5], 16)]) if i in own else t.encode() for i, t in enumerate(self.v.text)]
        text = b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices, as {(from, to): weight}."""
    by_start: dict[State, list] = {}
    for (m, e), w in b.items():
        by_start.setdefault(m, []).append((e, w))
    out: dict = {}
    for (s, m), w in a.items():
        for e, x in by_start.get(m, []):
            if w + x > out.get((s, e), NEVER):
                out[s, e] = w + x
    return out


def boundary_states(matrices: list[dict], at: State = (0, 0), end: State | None = None) -> list[State]:
    """The states of the best path from `at` to `end` (the text's end if None) at both ends of each chunk: suffix products, then forward."""
    ends = lambda e: e[1] == 0 if end is None else e == end
    suffix, total = [], None
    for m in reversed(matrices):
        total = m if total is None else product(m, total)
        suffix.append(total)
    suffix.reverse()
    out = [at]
    for i, m in enumerate(matrices):
        rest = suffix[i + 1] if i + 1 < len(matrices) else None
        onward: dict[State, float] = {}
        for (s, e), w in (rest or {}).items():
            if ends(e):
                onward[s] = max(w, onward.get(s, NEVER))
        best = None
        for (s, e), w in m.items():
            if s == at:
                w += (onward.get(e, NEVER) if rest is not None else 0.0 if ends(e) else NEVER)
                if w > NEVER and (best is None or w > best[0]):
                    best = (w, e)
        if best is None:
            raise ValueError("no path")
        at = best[1]
        out.append(at)
    return out


_made: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    path = path or vocabulary(MODEL)
    if path not in _made:
        with open(path, "rb") as f:
            _made[path] = Encoder(f.read())
    return _made[path]


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def encoded(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    path = path or vocabulary(MODEL)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longest = encoder(path).v.longest

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.encode(t.as_py()) for t in part.column(1)], pa.binary())], names=["doc_id", "ids"])

    small = docs.filter(F.length("text") <= giant).mapInArrow(whole, "doc_id long, ids binary")
    # Giant texts, copies once; the blank in front is part of the text that is cut.
    big = docs.filter(F.length("text") > giant).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select("doc_id", F.xxhash64("text").alias("h"), "copies", "text")
    margin = longest + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        types = [("doc_id", pa.int64()), ("h", pa.int64()), ("copies", pa.int64()), ("i", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("part", pa.string())]
        for batch in batches:
            for at in range(batch.num_rows):
                *row, text = (batch.column(j)[at].as_py() for j in range(4))
                text = e.shown(text)
                for i in range(-(-len(text) // chunk)):
                    low, stop = max(i * chunk - margin, 0), min(len(text), (i + 1) * chunk)
                    yield _batch([(*row, i, i * chunk - low, stop - low, text[low : stop + margin])], types)

    cuts = big.mapInArrow(cut, "doc_id long, h long, copies long, i int, low int, high int, part string")
    chunks = written(cuts.repartition("doc_id", "h", "i"), "chunks")
    entry = pa.list_(pa.struct([("s", pa.list_(pa.int32())), ("w", pa.float64())]))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                m = e.matrix(row[5], row[3], row[4])
                yield _batch([(*row[:3], [{"s": [*s, *t], "w": w} for (s, t), w in m.items()])], [("doc_id", pa.int64()), ("h", pa.int64()), ("i", pa.int32()), ("m", entry)])

    made = "doc_id long, h long, i int, m array<struct<s:array<int>,w:double>>"
    keys = [("doc_id", pa.int64()), ("h", pa.int64())]
    levels = [written(chunks.select("doc_id", "h", "i", "low", "high", "part").mapInArrow(transfer, made), "matrices")]
    read = lambda rows: [{((x["s"][0], x["s"][1]), (x["s"][2], x["s"][3])): x["w"] for x in r["m"]} for r in rows]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                m = reduce(product, read(rows))
                yield _batch([(*key, [{"s": [*s, *t], "w": w} for (s, t), w in m.items()])], [*keys, ("i", pa.int32()), ("m", entry)])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, rows, over in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at, end = ((over[0], over[1]), (over[2], over[3])) if over else ((0, 0), None)
                states = boundary_states(read(rows), at, end)
                yield _batch([(*key, r["i"], [*a, *b]) for r, a, b in zip(rows, states, states[1:], strict=False)], [*keys, ("i", pa.int32()), ("s", pa.list_(pa.int32()))])

    # Groups have fan matrices at most, each of a few hundred numbers.
    up = F.floor(F.col("i") / fan).cast("int")
    grouped = F.sort_array(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("i", "m")))).alias("rows")
    n = (chunks.agg(F.max("i")).first()[0] or 0) + 1
    while n > fan:
        levels.append(written(levels[-1].groupBy("doc_id", "h", up.alias("g")).agg(grouped).mapInArrow(multiplied, made), "products"))
        n = -(-n // fan)
    state = "doc_id long, h long, i int, s array<int>"
    states = levels.pop().groupBy("doc_id", "h").agg(grouped).select("doc_id", "h", "rows", F.lit(None).cast("array<int>").alias("s")).mapInArrow(between, state)
    for level in reversed(levels):
        known = states.select("doc_id", "h", F.col("i").alias("g"), "s", F.lit(None).cast("int").alias("i"), F.lit(None).cast("array<struct<s:array<int>,w:double>>").alias("m"))
        both = level.withColumn("g", up).withColumn("s", F.lit(None).cast("array<int>")).unionByName(known)
        states = both.groupBy("doc_id", "h", "g").agg(grouped, F.max("s").alias("s")).select("doc_id", "h", "rows", "s").mapInArrow(between, state)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        types = [("doc_id", pa.int64()), ("h", pa.int64()), ("copies", pa.int64()), ("i", pa.int32()), ("ids", pa.binary())]
        for batch in batches:
            for *row, low, high, part, s in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                yield _batch([(*row, e.backtrace(part, low, high, (s[0], s[1]), (s[2], s[3])))], types)

    c, s = chunks.alias("c"), states.alias("s")
    traced = c.join(s, F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("c.h") == F.col("s.h")) & (F.col("c.i") == F.col("s.i"))).select("c.doc_id", "c.h", "c.copies", "c.i", "c.low", "c.high", "c.part", "s.s")
    pieces = traced.mapInArrow(trace, "doc_id long, h long, copies long, i int, ids binary")
    large = pieces.groupBy("doc_id", "h", "copies").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, copies, parts in zip(*(batch.column(i) for i in range(3)), strict=True):
                out = b"".join(p["ids"] for p in parts.as_py())
                for _ in range(copies.as_py()):
                    yield _batch([(doc_id.as_py(), out)], [("doc_id", pa.int64()), ("ids", pa.binary())])

    large = large.select("doc_id", "copies", "parts").mapInArrow(joined, "doc_id long, ids binary")
    return small.unionByName(large)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document: how many, their checksum, and the digest of the text decoded from them."""
    path = vocabulary(MODEL)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        types = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids.as_py()
                rows.append((doc_id, len(data) // 4, zlib.crc32(data), hashlib.sha256(e.decode(data).encode("utf-8", "surrogatepass")).hexdigest()))
            yield _batch(rows, types)

    return encoded(table(spark, sf_dir, "documents"), path).mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
