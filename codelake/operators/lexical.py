"""Keyword index and BM25 ranking over plain tables.

A search runs over blocks of ``BLOCK`` chunks that lie together by language and path.  For every block
and term the index holds the chunks that have the term, what it adds to each, and the largest of these.
``SPAN`` blocks of a snapshot meet a tile of queries in one task: a query's bound on a block is the
weighted sum of its terms' largest parts there; blocks are scored in the order of their bounds until
the next bound is under the query's last score so far.  Nothing else leaves a block out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import numbered, settle
from ..functions.text import code_terms

K1, B, WEIGHTS, LEAST_IDF = 1.2, 0.75, {"path": 2.0, "symbol": 4.0, "code": 1.0}, 1e-6
TOP, QUERY_TERMS = 100, 64
BLOCK, SPAN, QUERY_TILE = 512, 32, 1024


def _counted(chunks: DataFrame, *keys: str) -> DataFrame:
    """The keys, term and how often the path, the symbol and the code have it.

    A text is shorter than its terms as rows: where chunks are dealt out by keys, their terms are counted where they are.
    """
    fields = {"path": "path", "symbol": "symbol", "code": "excerpt"}
    tag = lambda name: lambda t: F.struct(t.alias("term"), F.lit(name).alias("field"))
    tagged = F.flatten(F.array(*(F.transform(code_terms(c), tag(name)) for name, c in fields.items())))
    rows = chunks.select(*keys, F.explode(tagged).alias("t")).select(*keys, "t.*")
    counts = [F.count_if(F.col("field") == name).cast("int").alias(f"tf_{name}") for name in fields]
    return rows.groupBy(*keys, "term").agg(*counts)


def postings(chunks: DataFrame) -> DataFrame:
    """snapshot_id, chunk_id, term and how often the path, the symbol and the code have it."""
    dealt = chunks.select("snapshot_id", F.col("id").alias("chunk_id"), "path", "symbol", "excerpt").repartition("snapshot_id", "chunk_id")
    return _counted(dealt, "snapshot_id", "chunk_id")


def document_lengths(chunks: DataFrame) -> DataFrame:
    n = sum((F.size(code_terms(c)) for c in ("path", "symbol", "excerpt")), F.lit(0))
    return chunks.select("snapshot_id", F.col("id").alias("chunk_id"), "path", "language", n.alias("n_tokens"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("snapshot_id").agg(F.count("*").alias("n_chunks"), F.avg("n_tokens").alias("avgdl"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("snapshot_id", "term").agg(F.count("*").alias("df"))


def query_terms(query: Column | str) -> Column:
    """Distinct terms in the order of the query, the first 64."""
    return F.slice(F.array_distinct(code_terms(query)), 1, QUERY_TERMS)


def allowed(df: DataFrame) -> DataFrame:
    """Rows that have a query's language and path prefix; null and empty ask for nothing."""
    by_language = (F.coalesce("want_language", F.lit("")) == "") | (F.col("language") == F.col("want_language"))
    return df.where(by_language & F.startswith(F.col("path"), F.coalesce("path_prefix", F.lit(""))))


def wishes(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select("query_id", "snapshot_id", F.col("language").alias("want_language"), "path_prefix", *more)


def blocked(index: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """The index for search: terms (snapshot_id, term, idf), blocks (by span, block and term) and chunks (by span and block)."""
    stats, placed = settle(corpus_stats(lengths), "stats"), _placed(lengths)
    return _in_blocks(index.join(placed, ["snapshot_id", "chunk_id"]), placed, stats)


def blocked_chunks(chunks: DataFrame) -> dict[str, DataFrame]:
    """The same of chunks: their texts are dealt out by block, and no posting is moved or stored before it is in its block."""
    lengths = settle(document_lengths(chunks), "lengths")
    stats, placed = settle(corpus_stats(lengths), "stats"), _placed(lengths)
    keys = ["snapshot_id", "span", "block", "slot", "n_tokens"]
    texts = chunks.select("snapshot_id", F.col("id").alias("chunk_id"), "path", "symbol", "excerpt").join(placed.drop("path", "language"), ["snapshot_id", "chunk_id"])
    dealt = texts.select(*keys, "path", "symbol", "excerpt").repartition("snapshot_id", "span", "block")
    return _in_blocks(_counted(dealt, *keys), placed, stats)


def _placed(lengths: DataFrame) -> DataFrame:
    order = numbered(lengths, "snapshot_id", "language", "path", "chunk_id", label="chunks")
    block = F.floor(F.col("pos") / BLOCK)
    placed = order.select("snapshot_id", "chunk_id", "path", "language", "n_tokens", F.floor(block / SPAN).alias("span"), (block % SPAN).cast("int").alias("block"), (F.col("pos") % BLOCK).cast("int").alias("slot"))
    return settle(placed, "chunks")


def _in_blocks(counted: DataFrame, placed: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    rare = F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(rare > 0, rare).otherwise(LEAST_IDF)
    f = sum((F.col(f"tf_{name}") * w for name, w in WEIGHTS.items()), F.lit(0.0))
    part = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
    met = counted.withColumn("f", f).join(stats, "snapshot_id")
    held = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))  # noqa: E731  of BLOCK at most
    place = ["snapshot_id", "span", "block"]
    blocks = met.select(*place, "term", "slot", part.alias("part")).groupBy(*place, "term").agg(held("slot", "part").alias("x"), F.max("part").alias("most"))
    chunks = placed.groupBy(*place).agg(held("slot", "chunk_id", "path", "language").alias("x"))
    stored = settle(blocks.select(*place, "term", F.col("x.slot").alias("slots"), F.col("x.part").alias("parts"), "most"), "blocks")
    # how many chunks have a term, by what blocks hold: postings themselves are made once
    terms = stored.groupBy("snapshot_id", "term").agg(F.sum(F.size("slots")).alias("df")).join(stats, "snapshot_id").select("snapshot_id", "term", idf.alias("idf"))
    return {
        "terms": settle(terms, "terms"),
        "blocks": stored,
        "chunks": settle(chunks.select(*place, F.col("x.slot").alias("slots"), F.col("x.chunk_id").alias("ids"), F.col("x.path").alias("paths"), F.col("x.language").alias("languages")), "blocks"),
    }


def bm25(index: DataFrame, lengths: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, chunk_id, score, rank: the best chunks of each query's snapshot; statistics are those of the whole snapshot, filters come before the limit."""
    wanted = queries.select("snapshot_id", F.explode(query_terms("query")).alias("term")).distinct()
    return bm25_of_blocks(blocked(index.join(wanted, ["snapshot_id", "term"], "left_semi"), lengths), queries, top)


def bm25_of_blocks(built: dict[str, DataFrame], queries: DataFrame, top: int = TOP) -> DataFrame:
    """The same over a stored index (``blocked``)."""
    return ranked(_searched(built, queries, top).where("chunk_id is not null").select("query_id", "chunk_id", F.round("score", 9).alias("score")), top)


def blocks_scored(built: dict[str, DataFrame], queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, n_blocks with a term of the query, n_scored: how many of them the bounds could not leave out."""
    counts = _searched(built, queries, top).where("chunk_id is null")
    return counts.groupBy("query_id").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_scored").alias("n_scored"))


def _searched(built: dict[str, DataFrame], queries: DataFrame, top: int) -> DataFrame:
    """Each task's best chunks of its queries, and, with a null chunk, its counts of blocks."""
    per_snapshot = queries.groupBy("snapshot_id").agg(F.ceil(F.count("*") / QUERY_TILE).alias("n_tiles"))
    tiled = wishes(queries, query_terms("query").alias("terms")).join(per_snapshot, "snapshot_id").withColumn("tile", F.pmod(F.xxhash64("query_id"), "n_tiles"))
    asked = tiled.select("snapshot_id", "tile", "query_id", "want_language", "path_prefix", F.explode("terms").alias("term")).join(built["terms"], ["snapshot_id", "term"])
    asked = settle(asked, "asked")
    # a hot term meets each tile of queries once, not each query that has it
    found = built["blocks"].join(asked.select("snapshot_id", "tile", "term").distinct(), ["snapshot_id", "term"])
    key, none = ["snapshot_id", "tile", "span"], F.lit(None)
    own = built["chunks"].join(asked.select("snapshot_id", "tile").distinct(), "snapshot_id")
    texts = lambda c: none.cast("array<string>").alias(c)
    left = found.select(*key, "block", "slots", "term", "parts", "most", texts("ids"), texts("paths"), texts("languages")).unionByName(
        own.select(*key, "block", "slots", none.cast("string").alias("term"), none.cast("array<double>").alias("parts"), none.cast("double").alias("most"), "ids", "paths", "languages")
    )
    spans = built["chunks"].select("snapshot_id", "span").distinct()
    right = asked.join(spans, "snapshot_id").select(*(F.col(c).alias(f"of_{c}") for c in key), "query_id", "want_language", "path_prefix", "term", "idf")
    met = left.groupBy(*key).cogroup(right.groupBy(*(f"of_{c}" for c in key)))
    return met.applyInPandas(_score_span(top), "query_id long, chunk_id string, score double, n_blocks long, n_scored long")


class _Span:
    """Blocks of one task: which chunks they hold, and their postings by term."""

    def __init__(self, rows: pd.DataFrame):
        size = SPAN * BLOCK
        self.ids, self.paths, self.languages = (np.full(size, None, dtype=object) for _ in range(3))
        self.postings: dict[str, dict[int, tuple[np.ndarray, np.ndarray, float]]] = {}
        for r in rows.itertuples(index=False):
            at = r.block * BLOCK + np.asarray(r.slots, dtype=np.int64)
            if r.term is None:
                self.ids[at], self.paths[at], self.languages[at] = r.ids, r.paths, r.languages
            else:
                self.postings.setdefault(r.term, {})[r.block] = (at, np.asarray(r.parts, dtype=np.float64), r.most)
        self.held = np.flatnonzero(self.ids != None)  # noqa: E711
        self.order = np.full(size, size, dtype=np.int64)  # places of the ids in their order, for ties
        self.order[self.held[np.argsort(self.ids[self.held], kind="stable")]] = np.arange(len(self.held))
        self.allowed_by: dict[tuple[str, str], np.ndarray] = {}

    def allowed(self, language: str | None, prefix: str | None) -> np.ndarray:
        wish = (language or "", prefix or "")
        if wish not in self.allowed_by:
            fits = np.zeros(len(self.ids), dtype=bool)
            fits[self.held] = [wish[0] in ("", self.languages[i]) and self.paths[i].startswith(wish[1]) for i in self.held]
            self.allowed_by[wish] = fits
        return self.allowed_by[wish]

    def best(self, terms: list[tuple[str, float]], allowed: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Places and scores of the best chunks; how many blocks have a term, and how many were scored."""
        bounds, has = np.zeros(SPAN), np.zeros(SPAN, dtype=bool)
        for term, idf in terms:
            for block, (_, _, most) in self.postings.get(term, {}).items():
                bounds[block] += idf * most
                has[block] = True
        n_blocks = int(has.sum())
        has &= allowed.reshape(SPAN, BLOCK).any(1)
        queue = [b for b in np.argsort(-bounds, kind="stable").tolist() if has[b]]
        places, scores, last, scored, step = np.empty(0, np.int64), np.empty(0), -np.inf, 0, 1
        while queue and bounds[queue[0]] + 1e-8 >= last:  # scores are rounded to 9 digits
            now, queue, step = queue[:step], queue[step:], 2 * step
            now = {b for b in now if bounds[b] + 1e-8 >= last}
            scored += len(now)
            parts = [(at, idf * w) for term, idf in terms for b, (at, w, _) in self.postings.get(term, {}).items() if b in now]
            sums = np.bincount(np.concatenate([at for at, _ in parts]), weights=np.concatenate([w for _, w in parts]), minlength=len(self.ids))
            new = np.flatnonzero((sums > 0) & allowed)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, np.round(sums[new], 9)])
            if len(scores) > top:
                kept = np.lexsort((self.order[places], -scores))[:top]
                places, scores = places[kept], scores[kept]
                last = scores[-1]
        return places, scores, n_blocks, scored


def _score_span(top: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            span = _Span(rows)
            for query, own in asked.groupby("query_id", sort=False):
                wish = own.iloc[0]
                places, scores, n_blocks, scored = span.best(sorted(zip(own["term"], own["idf"], strict=True)), span.allowed(wish["want_language"], wish["path_prefix"]), top)
                out.append(pd.DataFrame({"query_id": query, "chunk_id": [*span.ids[places], None], "score": [*scores, 0.0], "n_blocks": [*([0] * len(places)), n_blocks], "n_scored": [*([0] * len(places)), scored]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "score": [], "n_blocks": [], "n_scored": []})

    return run


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each query by (score descending, id), with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
