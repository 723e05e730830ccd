"""Exact top-k inner-product search by columnar branch and bound.

Vectors are kept dimension by dimension (vertical layout). A query adds up its
score block of dimensions by block; after each, the Cauchy-Schwarz mass of the
dimensions still to come bounds every candidate from both sides, and those that
can no longer reach the k-th best lower bound are compacted away. What survives
is scored in exact integers.

Queries and candidates are dealt into blocks of bounded size; one task holds one
pair of blocks, so nothing is broadcast and no task grows with the table. In a
first pass each block of queries meets one block of candidates, which gives each
query a floor, the score of its k-th best there; in the second it carries the
floor to all other blocks, where it prunes from the first dimension on, and by the
vectors' lengths before. Candidates travel once for each block of queries: with a
query for every 50 rows, N rows travel N / (50 * query_rows) times, so 10 million
vectors 13 times and a billion 1,221 times.

Defined cases: vectors that are null, or hold a null or non-finite component,
and rows with a null id take no part; only vectors of equal length are compared
(an empty vector scores 0 with other empty ones); every row is a candidate for
every other, so rows that repeat an id are each asked for and each found, and
find one another; copies of a row travel once with their number; ties go to the
smaller id; an empty table gives an empty result. Component products must fit in
63 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_engine.llm.common import table, written

OUT = "query_id long, q long, n_q long, vec_id long, score long, n long"


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a vector that takes no part."""
    x = F.transform(vec, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vec.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def block_top_k(own: np.ndarray, q: np.ndarray, floors: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, width: int) -> list[list[tuple[int, int]]]:
    """For each query the (place, score) of its k best among the candidates of a block, without the place `own` (-1: none) and without those that cannot reach its floor."""
    dims = q.shape[1]
    by_mass = np.argsort(-(c.astype(np.float64) ** 2).sum(0), kind="stable")
    column = np.ascontiguousarray(c[:, by_mass].T.astype(np.float64))
    starts = list(range(0, dims, width))
    rest = [np.sqrt((column[s + width :] ** 2).sum(0)) for s in starts]
    out, places, length = [], np.arange(len(cid)), np.sqrt((column**2).sum(0))
    for self_, vec, floor in zip(own.tolist(), q, floors.tolist(), strict=True):
        x = vec[by_mass].astype(np.float64)
        alive = places[places != self_]
        if floor > -math.inf:
            most = math.sqrt((x**2).sum()) * length[alive]
            alive = alive[most + 1e-9 * most + 1e-6 >= floor]
        score = np.zeros(len(alive))
        for s, mass in zip(starts, rest, strict=True):
            if len(alive) <= k:
                break
            score = score + x[s : s + width] @ column[s : s + width, alive]
            bound = math.sqrt((x[s + width :] ** 2).sum()) * mass[alive]
            bound += 1e-9 * (np.abs(score) + bound) + 1e-6
            floor = max(floor, np.partition(score - bound, -k)[-k])
            stays = score + bound >= floor
            alive, score = alive[stays], score[stays]
        exact = c[alive] @ vec
        best = np.lexsort((cid[alive], -exact))[:k]
        out.append([(int(alive[i]), int(exact[i])) for i in best])
    return out


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, width: int = 16, candidate_rows: int = 8192, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables (id long, vec array<long>); every query must be a row of the candidates, too."""
    c_blocks = max(1, math.ceil(candidates.count() / candidate_rows))
    q_blocks = max(1, math.ceil(queries.count() / query_rows))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    counted = lambda df: df.groupBy("id", "vec").agg(F.count("*").alias("n"))
    # q tells the vectors of a repeated id apart.
    q = counted(queries).select("id", "vec", "n", F.xxhash64("vec").alias("q"), dealt(q_blocks).alias("qb"))
    c = counted(candidates).select("id", "vec", "n", dealt(c_blocks).alias("cb"))
    first = F.pmod("qb", F.lit(c_blocks)).cast("int")  # the block of candidates that a block of queries meets first
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, ...]] = []
        of_length = lambda df: dict(list(df.groupby(df["vec"].map(len)))) if len(df) else {}
        ours, theirs = of_length(left), of_length(right)
        for dims in ours.keys() & theirs.keys():
            asked, rows = ours[dims], theirs[dims]
            stacked = lambda df: np.array(df["vec"].tolist(), dtype=np.int64).reshape(len(df), dims)  # noqa: B023, E731
            ids, n, vecs = rows["id"].to_numpy(), rows["n"].to_numpy(), stacked(rows)
            place = {(i, v.tobytes()): at for at, (i, v) in enumerate(zip(ids.tolist(), vecs, strict=True))}
            mine = stacked(asked)
            at = [place.get((i, v.tobytes()), -1) for i, v in zip(asked["id"].tolist(), mine, strict=True)]
            alone = np.array([x if x >= 0 and n[x] == 1 else -1 for x in at])
            for i, x, key, times, best in zip(asked["id"].tolist(), at, asked["q"].tolist(), asked["n"].tolist(), block_top_k(alone, mine, asked["floor"].to_numpy(np.float64), ids, vecs, k, width), strict=True):
                out += [(i, key, times, int(ids[y]), score, int(n[y]) - (x == y)) for y, score in best]
        return pd.DataFrame(out, columns=["query_id", "q", "n_q", "vec_id", "score", "n"])

    renamed = lambda df: df.select(*[F.col(x).alias(x) for x in df.columns])  # noqa: E731  both sides come from one table
    met = lambda left, right: renamed(left).groupBy("qb", "cb").cogroup(renamed(right).groupBy("qb", "cb")).applyInPandas(pair, OUT)
    no_floor = F.lit(-math.inf).alias("floor")
    near = met(q.select("id", "vec", "n", "q", no_floor, "qb", first.alias("cb")), c.select("id", "vec", "n", F.explode(F.filter(every(q_blocks), lambda i: i % c_blocks == F.col("cb"))).alias("qb"), "cb"))
    found = near
    if c_blocks > 1:
        near = written(near, "near")
        floors = near.groupBy(F.col("query_id").alias("id"), "q").agg(F.when(F.sum("n") >= k, F.min("score").cast("double")).alias("floor"))
        asked = q.join(floors, ["id", "q"], "left").select("id", "vec", "n", "q", F.coalesce("floor", F.lit(-math.inf)).alias("floor"), "qb", F.explode(F.filter(every(c_blocks), lambda i: i != first)).alias("cb"))
        found = near.unionByName(met(asked, c.select("id", "vec", "n", F.explode(F.filter(every(q_blocks), lambda i: i % c_blocks != F.col("cb"))).alias("qb"), "cb")))
    # Each copy found is a row, k of them are enough; each copy of a query gets them all.
    found = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("n_q", F.explode(F.sequence(F.lit(1), F.col("n_q").cast("int")))).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("vec")).filter("id is not null and vec is not null")
    return exact_top_k(rows.filter(F.col("id") % 50 == 0), rows)


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
