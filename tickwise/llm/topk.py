"""Exact top-k inner-product search by no-random-access aggregation (operator 10).

Candidates are dealt into blocks by a hash of their id, queries into blocks likewise; each pair of a query
block and a candidate block is one group of bounded size (a stated query set against all rows, in blocks).
Within a group, every dimension is a list of the candidates sorted by that component. A query reads its lists
sequentially from the end that its sign favours, to one depth per round; all queries of the group read together.
What has been read gives each candidate a lower bound, and the lists' frontiers an upper bound. A query stops
when all but a few candidates' upper bounds are below its k-th lower bound; those few get their final scores.
After the last round the candidates still open get theirs, however many they are. The best of the blocks are ranked per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
#: Shares of every list read before the bounds are compared.
_ROUNDS = (0.5, 0.75, 0.9, 0.95)
#: Queries whose bounds are held at a time.
_AT_ONCE = 64


class SortedLists:
    """The candidates of a block and, per dimension, their order by that component.

    A query of weight ``w`` reads list ``d`` from its top if ``w[d] > 0``, from its bottom if ``w[d] < 0``. What
    all queries have read at a depth is the same up to that choice, so one product of the weights (split by sign)
    with the values read adds up every query's lists at once.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order].T.copy()  # dimension x candidate
        self.rank = np.argsort(np.argsort(self.x, axis=1, kind="stable"), axis=1, kind="stable")
        self.sorted = np.sort(self.x, axis=1)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Values that give lower and upper bounds after ``depth`` reads of each list (top half, then bottom half):
        a value that was read stands for itself, another for the list's far end or for the last value read."""
        n = self.x.shape[1]
        top, bottom = self.rank >= n - depth, self.rank < depth
        least, most = self.sorted[:, :1], self.sorted[:, -1:]
        low = np.concatenate([np.where(top, self.x, least), np.where(bottom, self.x, most)])
        high = np.concatenate([np.where(top, self.x, self.sorted[:, n - depth][:, None]),
                               np.where(bottom, self.x, self.sorted[:, depth - 1][:, None])])
        return low, high

    def search(self, qids: np.ndarray, weights: np.ndarray, k: int):
        """``(query's place, candidate id, score)`` arrays of the ``k`` best of every query, ties to the smaller id."""
        n = self.x.shape[1]
        split = np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], axis=1)
        own = np.searchsorted(self.ids, qids, side="left"), np.searchsorted(self.ids, qids, side="right")
        none = np.iinfo(np.int64).min if weights.dtype == np.int64 else -np.inf  # (objects compare with it as well)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo = np.arange(len(qids))
        few = max(min(4 * k, (n + k) // 2), n // 32)
        depths = sorted({int(n * share) for share in _ROUNDS} - {0}) if n > k else []
        for depth in depths:
            low_values, high_values = self.bounds(depth)
            later = []
            for some in np.array_split(todo, max(1, -(-len(todo) // _AT_ONCE))):
                low, high = split[some] @ low_values, split[some] @ high_values
                for i, q in enumerate(some):
                    low[i, own[0][q]:own[1][q]] = high[i, own[0][q]:own[1][q]] = none
                bar = np.partition(low, n - k, axis=1)[:, n - k]
                open_ = (high >= bar[:, None]) & (high != none)  # outsiders cannot qualify
                settled = (open_.sum(axis=1) <= few) | (depth == depths[-1])
                later.append(some[~settled])
                for i in np.flatnonzero(settled):
                    at = np.flatnonzero(open_[i])
                    found.append((some[i], at, weights[some[i]] @ self.x[:, at]))
            todo = np.concatenate(later)
        for q in todo:  # no more than k candidates, or lists too short to part
            at = np.flatnonzero((np.arange(n) < own[0][q]) | (np.arange(n) >= own[1][q]))
            found.append((q, at, weights[q] @ self.x[:, at]))
        out = []
        for q, at, score in found:
            if score.dtype == object:
                best = np.array(sorted(range(len(at)), key=lambda i: (-score[i], self.ids[at[i]]))[:k], dtype=np.int64)
            else:
                best = np.lexsort((self.ids[at], -score))[:k]
            out.append((np.full(len(best), q), self.ids[at[best]], score[best] if score.dtype == object else score[best].astype(np.int64)))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles: as doubles while every inner product of them is exact, else as integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    most = float(np.abs(x).max(initial=0)) * scale
    if x.shape[1] * most * most < 2**53:
        return v
    if x.shape[1] * most * most < 2**62:
        return v.astype(np.int64)
    whole = np.vectorize(lambda y: int(y) * scale if abs(y) >= 2**53 else math.floor(y * scale), otypes=[object])
    return whole(x) if x.size else x.astype(object)


_LONG = 1 << 63


def _sortable(s: int) -> str:
    """A text that sorts as the number does."""
    digits = str(abs(s))
    if s >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(chr(105 - ord(c)) for c in digits)


def _search_group(k: int, scale: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found, beyond = [np.zeros(0, dtype=np.int64)] * 4, None
        if len(queries) and len(rows):
            both = quantised(np.concatenate([np.stack(f["v"].to_numpy()).astype(np.float64) for f in (rows, queries)]), scale)
            x, q = both[:len(rows)], both[len(rows):]
            at, *best = SortedLists(rows["id"].to_numpy(), x).search(queries["id"].to_numpy(), q, k)
            if best[1].dtype == object:
                beyond = [None if -_LONG <= s < _LONG else _sortable(s) for s in best[1]]
                best[1] = np.array([max(-_LONG, min(_LONG - 1, s)) for s in best[1]], dtype=np.int64)
            found = [queries["row"].to_numpy()[at], queries["id"].to_numpy()[at], *best]
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), found))).assign(beyond=beyond)

    return run


def usable(vectors: Column) -> Column:
    """True for a vector that is not null and holds only finite, non-null numbers."""
    return vectors.isNotNull() & F.coalesce(F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x)
                                                     & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def exact_topk(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
               vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` best rows by integer inner product.

    Ties go to the smaller id; a query's own id is never among its results; fewer candidates give fewer rows.
    Vectors that are null or hold null or non-finite components, and rows without an id, take no part.
    Only vectors of the query's own length are compared. Rows repeated in the input count each on their own: a query
    row that stands twice gives its list twice. Inner products are exact for components of any size; a score beyond
    64 bits is ranked by its true value and given as the largest or smallest 64-bit integer.
    """
    good = cut(rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"),
        F.size(vector_col).alias("len"), is_query.alias("q")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_rows, n_queries = good.agg(F.count("*"), F.count_if(F.col("q"))).first()
    cb, qb = max(1, -(-n_rows // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    # dealt by the written row id, so that equal rows spread evenly
    candidates = (good.select("id", "v", "len", F.pmod(F.xxhash64("row"), F.lit(cb)).alias("c"))
                  .select("*", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("b")))
    queries = (good.where("q").select("row", "id", "v", "len", F.pmod(F.xxhash64("row"), F.lit(qb)).cast("int").alias("b"))
               .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cb - 1).cast("long"))).alias("c")))
    keys = ["len", "c", "b"]
    found = (queries.groupBy(*keys).cogroup(candidates.groupBy(*keys))
             .applyInPandas(_search_group(k, scale), "row long, query_id long, vec_id long, score long, beyond string"))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


#: The registered query in DuckDB SQL, over vectors whose products are exact in doubles.
ORACLE_SQL = """
with good as (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from good q join good c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from scores) where rank <= 20"""
