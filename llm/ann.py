"""Approximate nearest neighbours by a permutation index.

256 pivots are drawn from a bounded sample of the vectors. A vector is
represented by its 64 nearest pivots, nearest first, and posted in the inverted
file of each of them with its place there. Two vectors that agree in their
nearest pivots are close: the footrule distance of the two lists, with places
beyond the list counted as its end, is

    K (K + 1) - 2 * sum over shared pivots of (K - max(place, place))

so a query adds up its pivots' posting lists. The 640 vectors of a block with the
least footrule (ties to the smaller id) are reranked by the true distance.

A pivot is in a quarter of all lists, so a query adds up 16 entries for each
vector of a block. Lists of 128 take four times that; lists of 32 lose the
nearest of weakly clustered vectors (README has the recalls). With lists of 64
nearly every vector shares a pivot with a query, so there are no blocks to leave
out by pivots.

Every vector is indexed, in blocks of about 8192 by a hash of the row; queries go
to every block in blocks of their own, and a block answers with its ten nearest.
Of equal vectors in a block only the first eleven by id can be among a query's
ten nearest, so a vector that many rows share takes no more room than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.storage import stored

PIVOTS, LIST, RERANK, BLOCK, QUERIES = 256, 64, 640, 8192, 1024
SAMPLE = 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def places(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each vector's place of each pivot, k for those beyond its k nearest; ties go to the first pivot."""
    far = (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    out = np.full(far.shape, k, np.int16)
    np.put_along_axis(out, order, np.arange(k, dtype=np.int16)[None, :], axis=1)
    return out


def _search(shared, top: int, rerank: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "query_row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not rows.num_rows:
            return empty
        pivots = shared.value
        k = min(LIST, len(pivots))
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ids, own, vectors = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), _matrix(rows.column("v"))
        same = np.unique(vectors, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        keep = np.sort(order[nth <= top])
        ids, own, vectors = ids[keep], own[keep], vectors[keep]
        at = places(vectors, pivots, k)
        posted = [np.flatnonzero(at[:, p] < k) for p in range(len(pivots))]
        lists = [at[rows_, p].astype(np.int32) for p, rows_ in enumerate(posted)]
        asked, asking, wanted = queries.column("vec_id").to_numpy(), queries.column("row").to_numpy(), _matrix(queries.column("v"))
        n = min(len(ids), max(8 * top, rerank))
        found: tuple[list, list, list, list] = ([], [], [], [])
        for q, r, v, mine in zip(asked, asking, wanted, places(wanted, pivots, k)):
            shared_part = np.zeros(len(ids), np.int32)
            for p in np.flatnonzero(mine < k):
                shared_part[posted[p]] += k - np.maximum(lists[p], mine[p])
            near = np.sort(np.argpartition(-shared_part.astype(np.int64) * len(ids) + np.arange(len(ids)), n - 1)[:n])
            near = near[own[near] != r]
            score = np.sqrt(((vectors[near] - v) ** 2).sum(1))
            best = np.lexsort((ids[near], score))[:top]
            found[0].append(np.full(len(best), q))
            found[1].append(ids[near][best])
            found[2].append(score[best])
            found[3].append(np.full(len(best), r))
        return pa.table({"query_id": np.concatenate(found[0]).astype(np.int64), "query_row": np.concatenate(found[3]).astype(np.int64), "vec_id": np.concatenate(found[1]).astype(np.int64), "score": np.concatenate(found[2]).astype(float)})

    return run


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, row, v) of the vectors that take part: finite, not zero, of the most common length; `row` tells rows of one id apart."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = stored(rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "v"), "ann-vectors")
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "n").first()
    return rows.where(F.size("v") == (most.n if most else 0))


def neighbours(vectors: DataFrame, *, is_query: Column, top: int = 10, rerank: int = RERANK, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The `top` nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    `is_query` picks queries by the column vec_id. Candidates are all rows but
    the query's own, nearest first, ties to the smaller id. Rows that share an id
    are rows of their own, as queries and as candidates, also where they are
    equal. Vectors that are null, zero, of an uncommon length, or hold null or
    non-finite components take no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()
    drawn = list(dict.fromkeys(tuple(r.v) for r in sample))[:PIVOTS]
    pivots = spark.sparkContext.broadcast(np.array(drawn, float))
    queries = rows.where(is_query)
    blocks = max(1, -(-rows.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERIES))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    left = queries.withColumn("part", deal(groups, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", deal(blocks, 2)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(pivots, top, rerank), "query_id long, query_row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
