"""Exact top-k by inner product with a pivot table (LAESA).

The distances of every vector to the pivots are computed once. For a query q and a vector x,
the largest |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner product. Candidates are
evaluated in the order of that bound until the next bound is below the k-th best score.

Queries and candidates are dealt to blocks by hash, and each pair of blocks is one task's
work with bounded memory. Each pair of blocks returns k rows a query, from which the best
are taken per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.common import bucket_count, staged

PIVOTS, PIVOT_SAMPLE = 32, 2048
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
CHUNK = 512
#: Scaled components lie below this, so that products of up to 1,024 dimensions fit 64 bits.
LARGEST = 1 << 26


def usable(vector: Column, scale: int = 256) -> Column:
    """False for a null vector and for one that holds a null, NaN, infinite or too large component."""
    small = lambda x: F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(float(LARGEST))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & small(x), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample's rows."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        diff = sample - sample[chosen[-1]]
        far = np.minimum(far, np.einsum("ij,ij->i", diff, diff))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _rows(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _with_distances(frames, pivots: np.ndarray, dim: int):
    for frame in frames:
        v = _rows(frame["v"], dim)
        gap = np.sqrt(np.maximum(0.0, (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)[None, :]))
        yield pd.DataFrame({"id": frame["id"], "q": frame["q"], "v": [r.tobytes() for r in v], "d": [r.tobytes() for r in gap]})


def _stack(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search_block(q_id, q, q_d, ids, v, d, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best others in one block, ties to the smaller id."""
    out, xx = [], (v * v).sum(1)
    d = np.ascontiguousarray(d.T)
    # doubles hold small products exactly; beyond, whole numbers of 64 bits do
    big = max([np.abs(x).max() for x in (q, v) if x.size], default=0) ** 2 * v.shape[1] >= 1 << 53
    whole = v.astype(np.int64) if big else v
    for one, vec, gaps in zip(q_id, q, q_d, strict=True):
        bound = np.abs(d[0] - gaps[0]) if len(d) else np.zeros(len(ids))
        for p in range(1, len(d)):
            np.maximum(bound, np.abs(d[p] - gaps[p]), out=bound)
        qq = float(vec @ vec)
        # float distances: give way by far more than their rounding
        most = (qq + xx - bound * bound) / 2 + 1e-6 * (qq + xx) + 1
        order = np.argsort(-most, kind="stable")
        best: list[tuple[int, int]] = []
        for at in range(0, len(order), CHUNK):
            if len(best) == k and most[order[at]] < -best[-1][0]:
                break
            some = order[at:at + CHUNK]
            score, of = whole[some] @ (vec.astype(np.int64) if big else vec), ids[some]
            keep = of != one
            if len(best) == k:
                keep &= score >= -best[-1][0]
            score, of = score[keep], of[keep]
            top = np.lexsort((of, -score))[:k]
            best = sorted(best + [(-int(score[j]), int(of[j])) for j in top])[:k]
        out += [(int(one), i, -s) for s, i in best]
    return out


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
                query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of each row that ``is_query`` marks.

    Components become floor(scale * x) with x as double; the score is their exact integer inner
    product. Rows with a null id or an unusable vector take no part, nor does a vector with
    |scale * x| of 2^26 or more in it; shorter vectors count as padded with zeros. Repeated rows (id and vector) count once;
    an id with several vectors counts with the best of them. Ties go to the smaller id. With
    fewer than k others all are returned, so a lone row or an empty table gives none.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = good.filter(F.col("id").isNotNull() & usable(F.col("e"), scale)).select(
        "id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"), "q").distinct()
    rows = staged(good, "vectors")
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    schema = "query_id long, vec_id long, score long"
    dim, n_query, n_cand = facts.dim or 0, bucket_count(facts.q or 0, query_block), bucket_count(facts.n, candidate_block)
    # a bounded sample, the same at each run
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toPandas()
    points = choose_pivots(_rows(sample["v"], dim), pivots)
    with_gaps = staged(rows.mapInPandas(lambda it: _with_distances(it, points, dim), "id long, q boolean, v binary, d binary"), "pivot-table")
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = with_gaps.filter("q").select("id", "v", "d", block(n_query, 1).alias("qb"), each(n_cand).alias("cb"))
    others = with_gaps.select("id", "v", "d", block(n_cand, 2).alias("cb"), each(n_query).alias("qb"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = search_block(left["id"].to_numpy(), _stack(left["v"]), _stack(left["d"]), right["id"].to_numpy(), _stack(right["v"]), _stack(right["d"]), k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = queries.groupBy("qb", "cb").cogroup(others.groupBy("qb", "cb")).applyInPandas(cell, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
