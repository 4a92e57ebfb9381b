"""Exact top-k inner products with vector-approximation files.

Vectors of integers are cut into cells of a power of two per component. The cells of a block
are scanned against a block of queries: a cell's corner bounds the product from above, and
the gap to the lower bound depends on the query alone. Only vectors whose upper bound reaches
the k-th best lower bound are looked at exactly, best bound first, until the k-th exact
product beats the next bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries, at most about.
BLOCK_ROWS = 32_768
QUERY_ROWS = 32_768
#: Bits of a cell number beside its sign.
CELL_BITS = 5
#: Queries scanned, and vectors read exactly, at a time.
AT_ONCE = 64
READ = 256


def quantise(vector: Column, scale: float = 1024.0) -> Column:
    """``floor(scale * x)`` of each component as a double; null when a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.int64).reshape(-1, dim)


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products in 64-bit integers."""
    return (vectors * query).sum(axis=1)


def block_topk(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of a block for each query: rows (query_id, vec_id, score)."""
    order = np.lexsort(ids[None, :])
    ids, vectors = ids[order], vectors[order]
    same = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, group = np.unique(same, return_index=True, return_inverse=True)
    # Equal vectors are scanned once; the smallest k + 1 distinct ids of each can matter.
    by_group = np.argsort(group, kind="stable")
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(group[by_group]) != 0) | (np.diff(ids[by_group]) != 0)
    by_group = by_group[new]
    starts = np.searchsorted(group[by_group], np.arange(len(first)))
    ends = np.append(starts[1:], len(by_group))
    distinct = vectors[first]
    shift = max(0, int(np.abs(distinct).max(initial=0)).bit_length() - CELL_BITS)
    cells = distinct >> shift
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(cells).max(initial=0)) * vectors.shape[1]
    kind = np.float32 if reach < 2**24 else np.float64  # sums of whole numbers below these stay exact
    if reach >= 2**53:
        kind = np.int64
    scan = np.ascontiguousarray(cells.T.astype(kind))
    width = (1 << shift) - 1
    out_q, out_v, out_s = [], [], []
    # So many vectors have k ids beside the query's own, also where ids have several vectors.
    keep = min(k + 1 + len(by_group) - len(np.unique(ids)), len(distinct))
    for at in range(0, len(queries), AT_ONCE):
        some = queries[at:at + AT_ONCE]
        bounds = some.astype(kind) @ scan
        for row, query, own in zip(bounds, some, query_ids[at:at + AT_ONCE]):
            # upper = corner + high, lower = corner + low; both shift by the query alone
            upper = (row.astype(np.int64) << shift) + width * int(np.maximum(query, 0).sum())
            gap = width * int(np.abs(query).sum())
            least = np.partition(upper, len(upper) - keep)[len(upper) - keep] - gap if len(upper) else 0
            near = np.flatnonzero(upper >= least)
            near = near[np.argsort(-upper[near], kind="stable")]
            best: list[tuple[int, int]] = []  # (-score, id)
            for part in range(0, len(near), READ):
                if len(best) >= k and upper[near[part]] < -best[k - 1][0]:
                    break
                look = near[part:part + READ]
                scores = _exact(distinct[look], query)
                if len(best) >= k:
                    hit = scores >= -best[k - 1][0]
                    look, scores = look[hit], scores[hit]
                for g, score in zip(look.tolist(), scores.tolist()):
                    best.extend((-score, i) for i in ids[by_group[starts[g]:ends[g]][:k + 1]].tolist() if i != own)
                best = sorted(set(best))[:k]
            out_q += [own] * len(best)
            out_v += [i for _, i in best]
            out_s += [-s for s, _ in best]
    return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_s, np.int64)


def topk(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k highest integer inner products of every query: ``query_id, rank, vec_id, score``.

    Both tables have an integer id and an array; components become ``floor(scale * x)``.

    * A row never matches a query of its own id. Ties go to the smaller id.
    * Null vectors, vectors with a null or non-finite component, empty vectors and null ids take
      no part. Vectors of unequal length are never compared.
    * Rows that repeat an id and a vector count once, as candidates and as queries; an id with
      several vectors has a row for each different score.
    * Fewer candidates than k give fewer rows; an empty table gives an empty result.
    * Products must fit 64 bits. Other columns are not read.

    Candidates and queries are dealt in blocks; each pair of blocks is one task's work, and
    leaves k rows per query, which a window with a map-side limit merges. Nothing is broadcast.
    """
    def dealt(df: DataFrame, per: int) -> tuple[DataFrame, int]:
        clean = df.select(F.col(id_col).cast("long").alias("_id"), quantise(F.col(vector_col), scale).alias("_v"))
        clean = clean.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)).withColumn("_dim", F.size("_v"))
        blocks = max(1, -(-df.count() // per))
        return clean, blocks

    base, n = dealt(rows, BLOCK_ROWS)
    asked, m = dealt(queries, QUERY_ROWS)
    # A small table is cut finer, so that every core has a block.
    n = max(n, min(rows.sparkSession.sparkContext.defaultParallelism * 2, n * 16))
    # Rows are numbered as they are read: a hash of the row would put its copies together.
    base = base.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
    base = base.withColumn("_asked", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    asked = asked.withColumn("_asked", F.pmod(F.xxhash64("_id"), F.lit(m)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            dim = left.column("_dim")[0].as_py()
            found = block_topk(left.column("_id").to_numpy(), _matrix(left.column("_v"), dim), right.column("_id").to_numpy(), _matrix(right.column("_v"), dim), k)
        else:
            found = (np.array([], np.int64),) * 3
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    key = ["_block", "_asked", "_dim"]
    near = base.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = near.groupBy("query_id", "vec_id", "score").agg(F.count(F.lit(1)).alias("_n"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
