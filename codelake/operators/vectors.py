"""Vectors of chunks: encoding with reuse, and exact cosine search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import settle
from ..functions.text import code_terms, key_of
from .lexical import TOP, ranked

CHUNKING = "windows-v1"


class HashedEncoder:
    """Unit vectors of hashed terms; any object with ``fingerprint`` and ``encode(texts)`` can stand in."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.fingerprint = dimensions, f"hashed-terms@1:d{dimensions}:normalized:v1"

    def encode(self, term_lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(term_lists), self.dimensions))
        for i, terms in enumerate(term_lists):
            for t in terms:
                h = zlib.crc32(t.encode())
                out[i, h % self.dimensions] += 1.0 if h & 0x80000000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(texts: DataFrame, encoder, key: str = "key", text: str = "embedding_text") -> DataFrame:
    """key, vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "vector": list(np.asarray(encoder.encode(frame["terms"].to_list()), dtype=np.float32))})

    whole = F.coalesce(text, F.lit(""))
    prepared = code_terms(whole) if isinstance(encoder, HashedEncoder) else whole
    return texts.select(F.col(key).alias("key"), prepared.alias("terms")).mapInPandas(run, "key string, vector array<float>")


def with_embedding_key(chunks: DataFrame, fingerprint: str) -> DataFrame:
    return chunks.withColumn("key", key_of(F.lit(fingerprint), F.lit(f"chunks-{CHUNKING}"), "embedding_text"))


def reuse_embeddings(keyed: DataFrame, cache: DataFrame, encode_missing: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """keyed (with key and embedding_text) with vector and embedding_hit; and the rows that are new to the cache. Equal texts are encoded once."""
    missing = keyed.select("key", "embedding_text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = encode_missing(missing)
    known = cache.select("key", "vector", F.lit(True).alias("embedding_hit")).unionByName(new.select("key", "vector", F.lit(False).alias("embedding_hit")))
    return keyed.join(known, "key"), new


def embed(chunks: DataFrame, encoder, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reuse_embeddings(with_embedding_key(chunks, encoder.fingerprint), cache, lambda missing: encode(missing, encoder))


def vector_topk(vectors: DataFrame, queries: DataFrame, top: int = TOP, query_tile: int = 4096, vector_tile: int = 65_536) -> DataFrame:
    """query_id, chunk_id, score, rank: the nearest chunks of the query's snapshot by cosine.

    vectors: snapshot_id, chunk_id, path, language, vector; queries: query_id, snapshot_id, vector, language, path_prefix.
    Queries and vectors of a snapshot are dealt to tiles of about the sizes given; each pair of tiles is a task of its
    own that keeps ``top`` candidates per query, and these are ranked together.  The vectors are scanned once, however
    many queries there are; nothing comes to the driver.
    """
    held = vectors.where("vector is not null").select("snapshot_id", "chunk_id", "path", "language", F.col("vector").cast("array<double>").alias("vector"))
    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    wanted = queries.where("vector is not null").select("query_id", "snapshot_id", F.col("vector").cast("array<double>").alias("vector"), plain("language"), plain("path_prefix"))
    tiles = lambda df, size, name: df.groupBy("snapshot_id").agg(F.ceil(F.count("*") / size).alias(name))
    n = settle(tiles(held, vector_tile, "n_vector").join(tiles(wanted, query_tile, "n_query"), "snapshot_id"), "tiles")
    all_of = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    dealt = lambda key, name: F.pmod(F.xxhash64(key), name)
    left = held.join(n, "snapshot_id").withColumn("v", dealt("chunk_id", "n_vector")).withColumn("q", all_of("n_query"))
    right = wanted.join(n, "snapshot_id").withColumn("q", dealt("query_id", "n_query")).withColumn("v", all_of("n_vector"))
    right = right.select(F.col("snapshot_id").alias("of_snapshot"), F.col("q").alias("of_q"), F.col("v").alias("of_v"), "query_id", "vector", "language", "path_prefix")
    left = left.select("snapshot_id", "q", "v", "chunk_id", "path", "language", "vector")
    met = left.groupBy("snapshot_id", "q", "v").cogroup(right.groupBy("of_snapshot", "of_q", "of_v"))
    return ranked(met.applyInPandas(_nearest(top), "query_id long, chunk_id string, score double"), top)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best_rows(row: np.ndarray, score: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` entries of each row by (score descending, place)."""
    order = np.lexsort((at, -score, row))
    row, score, at = row[order], score[order], at[order]
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    nth = np.arange(len(row)) - np.repeat(begins, np.diff(np.r_[begins, len(row)]))
    return row[nth < top], score[nth < top], at[nth < top]


def _nearest(top: int, slab: int = 4096, rows: int = 256):
    def search(asked: np.ndarray, matrix: np.ndarray, fits: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and places of the best of each query of a few, slab by slab."""
        best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        least = np.full(len(asked), -np.inf)
        for a in range(0, len(matrix), slab):
            scores = np.round(asked @ matrix[a : a + slab].T, 6)
            for i, mask in enumerate(fits):
                if mask is not None:
                    scores[i, ~mask[a : a + slab]] = -np.inf
            if scores.shape[1] > top:  # what is under a slab's own last place, or under that of all so far, is out; ties stay
                least = np.maximum(least, np.partition(scores, -top, axis=1)[:, -top])
            row, at = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            best = _best_rows(*(np.concatenate([x, y]) for x, y in zip(best, (row, scores[row, at], at + a), strict=True)), top)
            full = np.bincount(best[0], minlength=len(asked)) == top
            lowest = np.full(len(asked), np.inf)
            np.minimum.at(lowest, best[0], best[1])
            least = np.where(full, np.maximum(least, lowest), least)
        return best

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})]
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("chunk_id", kind="stable").reset_index(drop=True)  # so that places order ties
            matrix, asked, masks = _unit(vectors["vector"]), _unit(queries["vector"]), {("", ""): None}
            for language, prefix in set(zip(queries["language"], queries["path_prefix"], strict=True)) - set(masks):
                fits = (vectors["language"] == language) if language else vectors["chunk_id"].notna()
                masks[language, prefix] = (fits & vectors["path"].str.startswith(prefix)).to_numpy(dtype=bool)
            wish = [masks[w] for w in zip(queries["language"], queries["path_prefix"], strict=True)]
            ids, query_ids = vectors["chunk_id"].to_numpy(), queries["query_id"].to_numpy()
            for a in range(0, len(asked), rows):
                row, score, at = search(asked[a : a + rows], matrix, wish[a : a + rows])
                out.append(pd.DataFrame({"query_id": query_ids[a + row], "chunk_id": ids[at], "score": score}))
        return pd.concat(out[1:] or out)

    return run
