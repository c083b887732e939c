"""Exact top-k by inner product with pivot-table elimination.

``pivots`` vectors, each far from those before it, are chosen from a sample of ``SAMPLE`` rows (which
affects speed alone).  The distances of every vector and every query to all pivots make the table.  By
the triangle inequality |d(q, p) - d(v, p)| is a lower bound of d(q, v); its maximum over the pivots
nearest to the query and nearest to the vector (where it is largest) gives an upper bound of the inner
product, (|q|^2 + |v|^2 - bound^2) / 2.  Each query's candidates are evaluated in the order of that
bound, until the next bound is under the k-th score found.  Nothing else ends a search.

Where vectors point in all directions evenly, the nearest is hardly nearer than the others and no
pivots exclude much (the README has figures); results are exact either way.

Scale: vectors and queries are packed into blocks where they lie, and every block of queries meets
every block of vectors (Spark broadcasts the smaller side while it is under its size limit, else it
pairs partitions); no row comes to the driver but the sample.  A task keeps k rows per query.

Edge cases: a null vector, or one with null or non-finite components, takes no part; vectors
shorter than others count as padded with zeros; equal scores are ordered by id; repeated ids are
separate candidates, but never partners of their own id, and ask once, with the least of their
vectors; fewer candidates than k are all returned; no vectors give an empty result.  Components may
reach 2^20 in size: sums stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE, NEAREST, BLOCK = 4096, 16, 1024

RESULT = "query_id long, vec_id long, score long"


def usable(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def quantised(vector: Column | str, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


class Search:
    """The best k of each query of one block, over the blocks of vectors that a task sees."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = query_ids, queries, k
        self.norms = (queries * queries).sum(1)
        self.best = np.full((len(queries), k), -np.inf)
        self.best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.evaluated = self.pairs = 0

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.best[rows], scores], axis=1)
        ids = np.concatenate([self.best_ids[rows], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.best[rows] = np.take_along_axis(scores, order, axis=1)
        self.best_ids[rows] = np.take_along_axis(ids, order, axis=1)

    def add(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, of_vectors: np.ndarray) -> None:
        """of_vectors: the vectors' rows of the pivot table."""
        norms, of_queries = (v * v).sum(1), _distances(self.q, pivots)
        near_v = np.argsort(of_vectors, axis=1)[:, :NEAREST]
        for a in range(0, len(self.q), 64):
            rows = np.arange(a, min(a + 64, len(self.q)))
            mine = of_queries[rows]
            near_q = np.argsort(mine, axis=1)[:, :NEAREST]
            bound = np.zeros((len(rows), len(v)))
            for j in range(near_q.shape[1]):
                np.maximum(bound, np.abs(of_vectors.T[near_q[:, j]] - np.take_along_axis(mine, near_q[:, j : j + 1], axis=1)), out=bound)
                np.maximum(bound, np.abs(mine[:, near_v[:, j]] - of_vectors[np.arange(len(v)), near_v[:, j]]), out=bound)
            # one unit of slack covers rounding in the distances
            most = np.floor((self.norms[rows, None] + norms[None, :] - np.maximum(bound - 1e-6, 0.0) ** 2) / 2.0) + 1.0
            most[self.ids[rows, None] == ids[None, :]] = -np.inf
            self.pairs += int(np.isfinite(most).sum())
            self._evaluate(rows, ids, v, most)

    def _evaluate(self, active: np.ndarray, ids: np.ndarray, v: np.ndarray, most: np.ndarray) -> None:
        order = np.argsort(-most, axis=1, kind="stable")
        bounds = np.take_along_axis(most, order, axis=1)
        at, step = 0, 32
        while at < len(v):
            open_ = np.isfinite(bounds[:, at]) & (bounds[:, at] >= self.best[active, -1])
            active, order, bounds = active[open_], order[open_], bounds[open_]
            if not len(active):
                return
            chosen, fine = order[:, at : at + step], np.isfinite(bounds[:, at : at + step])
            scores = np.where(fine, np.matmul(v[chosen], self.q[active][:, :, None])[:, :, 0], -np.inf)
            self._keep(active, scores, np.where(fine, ids[chosen], np.iinfo(np.int64).max))
            self.evaluated += int(fine.sum())
            at, step = at + step, 2 * step

    def result(self) -> pd.DataFrame:
        q, at = np.nonzero(np.isfinite(self.best))
        return pd.DataFrame({"query_id": self.ids[q], "vec_id": self.best_ids[q, at], "score": self.best[q, at].astype(np.int64)})


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Rows each farthest from those chosen before."""
    if not len(vectors):
        return vectors
    chosen, nearest = [0], _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(count, len(vectors)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def _packed(rows: DataFrame, width: int, names: tuple[str, str]) -> DataFrame:
    """Rows of up to BLOCK ids and vectors, as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), BLOCK):
                part = frame.iloc[a : a + BLOCK]
                yield pd.DataFrame({names[0]: [part["id"].to_numpy("<i8").tobytes()], names[1]: [_matrix(part["v"].to_list(), width).astype("<i4").tobytes()]})

    return rows.select("id", "v").mapInPandas(run, f"{names[0]} binary, {names[1]} binary")


def _scan(pivots, width: int, k: int):
    def unpacked(ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(v, "<i4").reshape(-1, width).astype(np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, searches, last, of_vectors, ids, v = pivots.value, {}, None, None, None, None
        for frame in frames:
            for query_ids, queries, vec_ids, vectors in frame.itertuples(index=False):
                if (vec_ids, vectors) != last:  # blocks may hold the same ids with other vectors
                    last, (ids, v) = (vec_ids, vectors), unpacked(vec_ids, vectors)
                    of_vectors = _distances(v, table)
                search = searches.get(query_ids)
                if search is None:
                    search = searches[query_ids] = Search(*unpacked(query_ids, queries), k)
                search.add(ids, v, table, of_vectors)
        for search in searches.values():
            yield search.result()

    return run


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, pivots: int = 1024, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product, for each query."""
    spark = vectors.sparkSession
    used = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    table = used.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("is_query"))
    width = table.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = _matrix([r.v for r in table.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], width)
    shared = spark.sparkContext.broadcast(far_apart(sample, pivots))
    asked = table.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = materialise(_packed(asked, width, ("query_ids", "queries")), "query-blocks")
    vector_blocks = materialise(_packed(table, width, ("vec_ids", "vectors")), "vector-blocks")
    met = query_blocks.crossJoin(vector_blocks).select("query_ids", "queries", "vec_ids", "vectors")
    found = met.mapInPandas(_scan(shared, width, k), RESULT)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
