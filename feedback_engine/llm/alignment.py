"""Cross-tokenizer alignment: what tokens of two tokenizers stand for the same bytes.

A document is encoded by both libraries, and the byte offsets where tokens of
both end cut it into groups. In Python, in Arrow batches, each document gives its
groups and its postings: the distinct pairs of ids that end together, with how
often. Documents of a portion are aligned as one array of bytes.

The rest are joins of DataFrames. Pair totals are added up before they travel;
for each id of B, a window over its pairs gives the highest. Then postings and
totals are cogrouped: both are shuffled by the pair, that is by the side id B,
divided by A, as a frequent B id may hold most rows; both sides are sorted
streams that spill. Each posting gives what its pair adds to its document, and
these contributions are summed by document. Pairs with more than 1 / HEAVY of all
postings, fewer than HEAVY, don't travel: their totals are broadcast.

Defined cases: null and empty texts, and those that a side does not give back
(U+2581 decodes to a blank), have no tokens: zeros and an empty digest. Rows that
repeat are rows of their own; only doc_id and text are read; an empty table gives
an empty one. Memory is bound by PORTION and by the longest row.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_engine.llm import byte_bpe, pieces
from feedback_engine.llm.common import small_batches, table, written
from feedback_engine.llm.tokens import vocabulary

#: Characters of text that are aligned at once.
PORTION = 1 << 19
#: Totals of fewer pairs than this are broadcast, some 300 KB.
HEAVY = 1 << 14
#: A text: tokens of A, of B, groups, the groups as text, its links as A << 32 | B in 64 bits.
Alignment = tuple[int, int, int, bytes, bytes]
NOTHING: Alignment = (0, 0, 0, b"", b"")


def sizes_of(table: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in table], np.int64)


class Aligner:
    """ranks: a byte-level tokenizer's, by token; model: a sentencepiece model that puts a blank in front."""

    def __init__(self, ranks: dict[bytes, int], model: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a_ids = tiktoken.Encoding("A", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.b_ids = b.encode
        self.a_token = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_token[i] = token
        shown = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_token = [bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace(pieces.BLANK, " ").encode() for i, t in enumerate(shown)]
        self.a_size, self.b_size = sizes_of(self.a_token), sizes_of(self.b_token)
        #: Ids as text with what follows them: within a side, at the end of A's part, at the end of a group.
        n, m = len(self.a_token), len(self.b_token)
        self.text = [b"%d%s" % (i, end) for end, many in ((b",", n), (b"|", n), (b",", m), (b";", m)) for i in range(many)]

    def align(self, texts: list[str]) -> list[Alignment]:
        """All texts at once: their tokens side by side are one array of bytes on both sides."""
        out: list[Alignment] = [NOTHING] * len(texts)
        a_of, b_of, kept = [], [], []
        for i, text in enumerate(texts):
            if text:
                data = f" {text}".encode()
                a, b = self.a_ids(f" {text}"), self.b_ids(text)
                if b"".join([self.a_token[x] for x in a]) == data == b"".join([self.b_token[x] for x in b]):
                    a_of.append(a)
                    b_of.append(b)
                    kept.append(i)  # both sides give the document back
        if not kept:
            return out
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_of, b_of))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group, group = np.searchsorted(common, a_end), np.searchsorted(common, b_end), np.arange(len(common))
        a_last, b_last = common[a_group] == a_end, common[b_group] == b_end
        links = (a[a_last] << 32 | b[b_last]).astype("<i8")
        # Of each group first A's tokens, then B's.
        n, m = len(self.a_token), len(self.b_token)
        stream = np.empty(len(a) + len(b), np.int64)
        stream[np.arange(len(a)) + np.searchsorted(b_group, group)[a_group]] = a + n * a_last
        stream[np.arange(len(b)) + np.searchsorted(a_group, group, "right")[b_group]] = b + 2 * n + m * b_last
        sizes = [np.array([len(x) for x in side]) for side in (a_of, b_of)]
        ends = [np.cumsum(x) for x in sizes]
        groups = np.searchsorted(common, a_end[ends[0] - 1], "right")
        stops = ends[0] + ends[1]
        for i, n_a, n_b, low, high, begin, stop in zip(kept, *(x.tolist() for x in (*sizes, np.append(0, groups[:-1]), groups, np.append(0, stops[:-1]), stops)), strict=True):
            shown = b"".join([self.text[x] for x in stream[begin:stop].tolist()])
            out[i] = (n_a, n_b, high - low, shown[:-1], links[low:high].tobytes())
        return out


def portions(texts: list[str], most: int = PORTION) -> list[list[str]]:
    """Runs of texts of up to `most` characters together; a longer one is alone."""
    out: list[list[str]] = []
    held = 0
    for t in texts:
        if not out or held + len(t) > most:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out


_made: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """Made once in each process."""
    if (a, b) not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[a, b] = Aligner(byte_bpe.read_ranks(a), b)
    return _made[a, b]


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, full: bool = False) -> DataFrame:
    """Of each row of docs (doc_id, text): its number r, doc_id, n_a, n_b, n_groups, groups_sha256, its postings links (array of pair and times), and, if full, groups as text.

    a: a file of ranks; b: a sentencepiece model. pair is A << 32 | B.
    """
    small_batches(docs.sparkSession)
    a, b = a or vocabulary(byte_bpe.RANKS), b or vocabulary(pieces.MODEL)

    def run(batch: pa.RecordBatch) -> list[tuple[str, pa.Array]]:
        own = aligner(a, b)
        counts, digests, shown, pairs, times, ends = [], [], [], [], [], [0]
        for *numbers, groups, links in chain.from_iterable(own.align(p) for p in portions([t or "" for t in batch.column(2).to_pylist()])):
            counts.append(numbers)
            digests.append(hashlib.sha256(groups).hexdigest() if groups else "")
            shown.append(groups.decode() if full else None)
            found, often = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
            pairs.append(found)
            times.append(often)
            ends.append(ends[-1] + len(found))
        flat = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)
        links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat(pairs)), pa.array(flat(times))], names=["pair", "times"]))
        out = [(name, pa.array([x[k] for x in counts], pa.int64())) for k, name in enumerate(("n_a", "n_b", "n_groups"))]
        return [("doc_id", batch.column(1)), *out, ("groups_sha256", pa.array(digests, pa.string())), ("links", links), *([("groups", pa.array(shown, pa.string()))] if full else [])]

    rows = docs.select(F.monotonically_increasing_id().alias("r"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    added = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair:long,times:long>>"
    return byte_bpe.by_batch(rows, ["r", "doc_id", "text"], run, added + (", groups string" if full else ""))


def pair_totals(postings: DataFrame) -> DataFrame:
    """Of each pair of postings (pair, times): its count, how many rows have it, and whether its B id has no higher count."""
    totals = postings.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("rows"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))  # as many rows as A has ids at most
    return totals.withColumn("best", F.col("count") == F.max("count").over(of_b))


def link_scores(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """rows (r, links; a written table) as r, n_links, n_best, count_sum; rows without links are left out."""
    postings = rows.select("r", F.inline("links"))
    totals = written(pair_totals(postings), "pair-totals")
    share = (totals.agg(F.sum("rows")).first()[0] or 0) // heavy
    frequent = F.col("rows") > share
    marked = postings.join(F.broadcast(totals.filter(frequent).drop("rows")), "pair", "left")  # fewer than `heavy` rows
    rest = marked.filter("count is null").select("pair", "r", "times").join(totals.filter(~frequent).drop("rows"), "pair")
    both = marked.filter("count is not null").select("r", "times", "count", "best").unionByName(rest.select("r", "times", "count", "best"))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    return both.groupBy("r").agg(F.sum("times").alias("n_links"), best.alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document, with what its links count in the whole corpus."""
    rows = written(aligned(table(spark, sf_dir, "documents")), "aligned")
    scores = link_scores(rows.select("r", "links"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.drop("links").join(scores, "r", "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256")
