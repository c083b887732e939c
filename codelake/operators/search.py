"""Ranked search for tables of queries: keyword, vector, fused, and expanded along the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import settle
from .lexical import allowed, bm25, bm25_of_blocks, ranked, wishes
from .vectors import vector_topk

STRATEGIES = ("vector-only", "bm25", "hybrid", "ast-aware")
ORIGINS = ["bm25", "vector", "exact-symbol", "dependency-expansion"]
FUSION, SEEDS, NEIGHBOURS, SHARE = 60, 20, 5, 0.5


def checked(queries: DataFrame, strategy: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Queries that can run, and blank ones as errors."""
    if strategy not in STRATEGIES or not 1 <= k <= 100:
        raise ValueError(f"strategy must be one of {STRATEGIES} and k between 1 and 100")
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    return queries.where(~blank), queries.where(blank).withColumn("error", F.lit("blank query"))


def admitted(queries: DataFrame, strategy: str, k: int, models: DataFrame | None = None, fingerprint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries that can run, and the others with an error: blank ones, and those whose snapshot was embedded by another model.

    models: snapshot_id, model; where the strategy compares vectors, it must be the fingerprint of the query's encoder.
    """
    good, blank = checked(queries, strategy, k)
    if strategy == "bm25" or models is None:
        return good, blank
    same = models.where(F.col("model").eqNullSafe(F.lit(fingerprint))).select("snapshot_id")
    other = good.join(models.select("snapshot_id"), "snapshot_id", "left_semi").join(same, "snapshot_id", "left_anti")
    errors = blank.unionByName(other.withColumn("error", F.lit("the snapshot has another embedding model")))
    return good.join(other.select("query_id"), "query_id", "left_anti"), errors


def fused(*channels: tuple[str, DataFrame]) -> DataFrame:
    """query_id, chunk_id, score, origins: sums of 1 / (60 + rank)."""
    rows = None
    for name, hits in channels:
        part = hits.select("query_id", "chunk_id", (1.0 / (FUSION + F.col("rank"))).alias("s"), F.lit(name).alias("origin"))
        rows = part if rows is None else rows.unionByName(part)
    return _collect(rows)


def _collect(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 12).alias("score"), F.collect_set("origin").alias("origins"))


def exact_symbols(queries: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id of chunks whose symbol's name is a word of the query, or whose qualified name is the query."""
    text = F.trim("query")
    words = queries.select("query_id", "snapshot_id", F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("name"))
    by_name = words.join(symbols.select("snapshot_id", "name", "id"), ["snapshot_id", "name"]).select("query_id", "snapshot_id", "id")
    whole = queries.select("query_id", "snapshot_id", text.alias("qualified_name"))
    by_qualified = whole.join(symbols.select("snapshot_id", "qualified_name", "id"), ["snapshot_id", "qualified_name"]).select("query_id", "snapshot_id", "id")
    hit = by_name.union(by_qualified).distinct().join(wishes(queries), ["query_id", "snapshot_id"])
    own = chunks.select("snapshot_id", F.col("symbol_id").alias("id"), F.col("id").alias("chunk_id"), "path", "language")
    return allowed(hit.join(own, ["snapshot_id", "id"])).select("query_id", "chunk_id")


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported paths by path, directed; related symbols by symbol, both ways; of resolved edges."""
    sure = edges.where(F.col("status") == "resolved")
    paths = sure.where("kind = 'import'").select("snapshot_id", F.col("source_path").alias("path"), F.col("target_path").alias("near_path")).distinct()
    ends = sure.where("kind <> 'import' and source_symbol is not null and target_symbol is not null").select("snapshot_id", "source_symbol", "target_symbol")
    both = ends.union(ends.select("snapshot_id", "target_symbol", "source_symbol")).distinct()
    return paths, both.toDF("snapshot_id", "symbol_id", "near_symbol")


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n smallest chunk ids of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))).where(F.col("__n") <= n).drop("__n")


def expand_one_hop(base: DataFrame, queries: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: neighbours of each query's 20 best chunks, five each, at half their score.

    A chunk takes five neighbours besides itself, so six per path and symbol are enough, however large the hub.
    """
    own = chunks.select("snapshot_id", F.col("id").alias("chunk_id"), "path", "symbol_id", "language")
    wish = wishes(queries)
    seeds = ranked(base.select("query_id", "chunk_id", "score"), SEEDS).select("query_id", F.col("chunk_id").alias("seed"), "score")
    seeds = settle(seeds.join(wish, "query_id").join(own.select("snapshot_id", F.col("chunk_id").alias("seed"), F.col("path").alias("seed_path"), F.col("symbol_id").alias("seed_symbol")), ["snapshot_id", "seed"]), "seeds")
    paths, related = adjacency(edges)
    who = ["want_language", "path_prefix"]  # queries with the same wishes share neighbours
    by_path = paths.withColumnRenamed("path", "seed_path")
    asked_paths = seeds.join(by_path, ["snapshot_id", "seed_path"]).select("query_id", "seed", "score", "snapshot_id", *who, "near_path")
    asked_symbols = seeds.join(related.withColumnRenamed("symbol_id", "seed_symbol"), ["snapshot_id", "seed_symbol"]).select("query_id", "seed", "score", "snapshot_id", *who, "near_symbol")

    def six(asked: DataFrame, near: str, key: str) -> DataFrame:
        reachable = own.withColumnRenamed(key, near).join(asked.select("snapshot_id", near).distinct(), ["snapshot_id", near], "left_semi")
        fitting = reachable.withColumn("path", F.col(near)) if key == "path" else reachable
        kinds = asked.select("snapshot_id", near, *who).distinct()  # a chunk meets the wishes of those who reach it
        kept = _first(allowed(fitting.join(kinds, ["snapshot_id", near])).select("snapshot_id", *who, near, "chunk_id"), ["snapshot_id", *who, near], NEIGHBOURS + 1)
        kept = kept.toDF("s2", "l2", "p2", "n2", "chunk_id")
        on = (asked["snapshot_id"] == kept["s2"]) & asked["want_language"].eqNullSafe(kept["l2"]) & asked["path_prefix"].eqNullSafe(kept["p2"]) & (asked[near] == kept["n2"])
        return asked.join(kept, on).select("query_id", "seed", "score", "chunk_id")

    near = six(asked_paths, "near_path", "path").union(six(asked_symbols, "near_symbol", "symbol_id")).where("chunk_id <> seed").distinct()
    five = _first(near, ["query_id", "seed"], NEIGHBOURS)
    return five.groupBy("query_id", "chunk_id").agg((F.max("score") * SHARE).alias("score"))


def search(
    queries: DataFrame,
    strategy: str,
    k: int,
    *,
    chunks: DataFrame,
    index: DataFrame | None = None,
    lengths: DataFrame | None = None,
    blocks: dict[str, DataFrame] | None = None,
    vectors: DataFrame | None = None,
    symbols: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, chunk_id, score, origins.  queries: query_id, snapshot_id, query, vector, language, path_prefix.

    The keyword index is given as stored ``blocks``, or as postings (``index``) and ``lengths``.
    """
    queries, _ = checked(queries, strategy, k)
    lexical = None
    if strategy != "vector-only":
        lexical = bm25_of_blocks(blocks, queries) if blocks else bm25(index, lengths, queries)
    semantic = vector_topk(vectors, queries) if strategy != "bm25" else None
    if strategy in ("bm25", "vector-only"):
        name, hits = ("bm25", lexical) if lexical is not None else ("vector", semantic)
        return hits.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score", F.array(F.lit(name)).alias("origins"))
    base = fused(("bm25", lexical), ("vector", semantic))
    if strategy == "ast-aware":
        exact = exact_symbols(queries, symbols, chunks).select("query_id", "chunk_id", F.lit(1.0 / (FUSION + 1)).alias("s"), F.array(F.lit("exact-symbol")).alias("origins"))
        rows = base.withColumnRenamed("score", "s").unionByName(exact)
        base = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 12).alias("score"), F.array_distinct(F.flatten(F.collect_list("origins"))).alias("origins"))
        base = settle(base, "base")
        more = expand_one_hop(base, queries, chunks, edges).select("query_id", "chunk_id", "score", F.array(F.lit("dependency-expansion")).alias("origins"))
        rows = base.unionByName(more)
        base = rows.groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), 12).alias("score"), F.array_distinct(F.flatten(F.collect_list("origins"))).alias("origins"))
    in_order = F.filter(F.array(*map(F.lit, ORIGINS)), lambda x: F.array_contains("origins", x))
    return ranked(base, k).select("query_id", "rank", "chunk_id", "score", in_order.alias("origins"))
