"""The library's three workloads: index snapshots, search, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import settle
from ..operators import binding, chunking, evaluate, evidence, lexical, structure, vectors
from ..operators.search import STRATEGIES, admitted, search
from ..sources import capture, snapshots


@dataclass
class Index:
    """Tables of indexed snapshots."""

    files: DataFrame
    skipped: DataFrame
    symbols: DataFrame
    imports: DataFrame
    refs: DataFrame
    edges: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    blocks: DataFrame
    block_chunks: DataFrame
    models: DataFrame
    parsed_cache: DataFrame
    embedding_cache: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.__dataclass_fields__}

    def keyword_blocks(self) -> dict[str, DataFrame]:
        return {"terms": self.terms, "blocks": self.blocks, "chunks": self.block_chunks}


def index_snapshots(raw: DataFrame, parsed_cache: DataFrame, embedding_cache: DataFrame, encoder=None, exclusions=(), extractors=None, **windows) -> Index:
    """raw: repository_id, snapshot_id, path, content (bytes).  Caches: key with structure, key with vector."""
    encoder = encoder or vectors.HashedEncoder()
    files, skipped = capture.capture(raw, exclusions)
    files = settle(files, "files")
    config, bad_config = capture.read_module_config(files)
    parsed, new_parsed = structure.reuse_parsed(files, parsed_cache, extractors)
    parsed = settle(parsed, "parsed")
    part = structure.tables_of(parsed)
    symbols, imports = part["symbols"], part["imports"]
    refs, edges = binding.bind(files, symbols, imports, part["refs"], part["barriers"], config)
    chunks = settle(chunking.make_chunks(files, symbols, part["statement_ends"], **windows), "chunks")
    embedded, new_vectors = vectors.embed(chunks, encoder, embedding_cache)
    own = F.monotonically_increasing_id()
    embedded = embedded.select("snapshot_id", F.col("id").alias("chunk_id"), "path", "language", "vector", "embedding_hit")
    postings, lengths = settle(lexical.postings(chunks), "postings"), settle(lexical.document_lengths(chunks), "lengths")
    built = lexical.blocked(postings, lengths)
    models = files.select("snapshot_id", F.lit(encoder.fingerprint).alias("model")).distinct()
    return Index(
        files, skipped.unionByName(bad_config), symbols, imports, refs, settle(edges.withColumn("edge_no", own), "edges"), chunks, settle(embedded, "vectors"),
        postings, lengths, built["terms"], built["blocks"], built["chunks"], models, new_parsed, new_vectors,
    )


def snapshot_metrics(index: Index) -> DataFrame:
    keys = ["snapshot_id"]
    return snapshots.metrics(index.files, index.chunks, *keys).join(snapshots.manifest(index.files, *keys), keys)


def with_query_vectors(queries: DataFrame, encoder=None) -> DataFrame:
    """Adds vector to (query_id, query, ...)."""
    encoder = encoder or vectors.HashedEncoder()
    made = vectors.encode(queries.select(F.col("query_id").cast("string").alias("key"), F.col("query").alias("embedding_text")), encoder)
    return queries.join(made, F.col("query_id").cast("string") == F.col("key")).drop("key")


def search_with_errors(index: Index, queries: DataFrame, strategy: str = "ast-aware", k: int = 10, encoder=None) -> tuple[DataFrame, DataFrame]:
    """Hits, and the queries that could not run, with an error.  queries: query_id long, snapshot_id, query, language, path_prefix."""
    encoder = encoder or vectors.HashedEncoder()
    good, errors = admitted(queries, strategy, k, index.models, encoder.fingerprint)
    ready = with_query_vectors(good, encoder) if "vector" not in good.columns else good
    found = search(ready, strategy, k, chunks=index.chunks, blocks=index.keyword_blocks(), vectors=index.vectors, symbols=index.symbols, edges=index.edges)
    own = index.chunks.select(F.col("id").alias("chunk_id"), "path", "symbol", "start_line", "end_line", "excerpt")
    return found.join(own, "chunk_id"), errors


def search_index(index: Index, queries: DataFrame, strategy: str = "ast-aware", k: int = 10, encoder=None) -> DataFrame:
    """The hits alone."""
    return search_with_errors(index, queries, strategy, k, encoder)[0]


def evidence_for(index: Index, queries: DataFrame, prompt: str = evidence.PROMPT, encoder=None) -> tuple[DataFrame, DataFrame]:
    """What of each query's 20 best chunks (ast-aware) fits into the window of an answer; and the queries that could not run."""
    hits, errors = search_with_errors(index, queries, "ast-aware", evidence.HITS, encoder)
    asked = queries.join(errors.select("query_id"), "query_id", "left_anti")
    return evidence.for_queries(hits, index.chunks, asked, prompt), errors


def evaluate_index(index: Index, queries: DataFrame, ranges: DataFrame, k: int = 20, encoder=None) -> DataFrame:
    """Metrics of every strategy for each query that has relevant chunks."""
    relevant = settle(evaluate.relevant_chunks(ranges, index.chunks), "relevant")
    ready = with_query_vectors(queries, encoder)
    runs = None
    for strategy in STRATEGIES:
        part = search_index(index, ready, strategy, k, encoder).select("query_id", F.lit(strategy).alias("strategy"), "rank", "chunk_id")
        runs = part if runs is None else runs.unionByName(part)
    asked = queries.select("query_id", F.explode(F.array(*map(F.lit, STRATEGIES))).alias("strategy"))
    return evaluate.retrieval_metrics(settle(runs, "runs"), relevant, "strategy", runs=asked)
