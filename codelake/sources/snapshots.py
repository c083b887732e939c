"""Snapshots: manifest, metrics, publication, retention and look-up by status."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["repository_id", "snapshot_id"]


def manifest(files: DataFrame, *keys: str) -> DataFrame:
    """One hash per snapshot over its (path, content hash) pairs in path order, as a JSON object."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
    pairs = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    body = F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["path"]), F.lit(": "), quoted(p["content_hash"]))), ", ")
    return files.groupBy(*keys).agg(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256).alias("content_manifest_hash"))


def metrics(files: DataFrame, chunks: DataFrame, *keys: str, seconds: Column | None = None) -> DataFrame:
    """Files, bytes and cache hits of each snapshot, and its chunks."""
    hits = F.count_if("parse_hit") if "parse_hit" in files.columns else F.lit(0).cast("long")
    embedded = F.count_if("embedding_hit") if "embedding_hit" in chunks.columns else F.lit(0).cast("long")
    of_files = files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"), hits.alias("parse_cache_hits"))
    of_chunks = chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), embedded.alias("embedding_cache_hits"))
    out = of_files.join(of_chunks, list(keys), "left").fillna(0, ["chunks", "embedding_cache_hits"])
    return out if seconds is None else out.withColumn("total_seconds", seconds).withColumn("files_per_second", F.try_divide("files", "total_seconds"))


def history(snapshots: DataFrame) -> DataFrame:
    """Newest first in each repository, with the position there (from 1)."""
    newest = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    return snapshots.withColumn("position", F.row_number().over(newest)).orderBy("repository_id", "position")


def require_ready(requests: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose repository and snapshot belong together and are ready; the others, with an error."""
    ready = snapshots.where(F.col("status") == "ready").select("repository_id", F.col("id").alias("snapshot_id"))
    return requests.join(ready, KEYS, "left_semi"), requests.join(ready, KEYS, "left_anti").withColumn("error", F.lit("snapshot is not ready"))


def stage(df: DataFrame, root: str, name: str, attempt: str) -> None:
    """Write a table's rows under their snapshot and the attempt that writes them; no reader sees them before its commit."""
    df.withColumn("attempt_id", F.lit(attempt)).write.mode("append").partitionBy(*KEYS, "attempt_id").parquet(f"{root}/{name}")


def commit(snapshot: DataFrame, root: str, attempt: str) -> None:
    """Write the snapshots' rows with the attempt that holds their tables, as one file: all of them are listed, or none."""
    snapshot.withColumns({"attempt_id": F.lit(attempt), "committed_at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(f"{root}/snapshots")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], snapshot: DataFrame) -> str:
    """Write all tables, and the snapshots' rows last; returns the attempt's id.

    Every call is an attempt of its own.  One that fails half-way leaves rows that nobody reads, and older snapshots as
    they were; a call that is repeated after its commit replaces what the first one has listed.
    """
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        stage(df, root, name, attempt)
    commit(snapshot, root, attempt)
    return attempt


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Identities in folder names stay texts, also where they look like numbers."""
    inferred = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inferred)
    spark.conf.set(inferred, "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(inferred, before)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """One row per published snapshot: that of its last commit."""
    last = Window.partitionBy("repository_id", "id").orderBy(F.desc("committed_at"), F.desc("attempt_id"))
    return spark.read.parquet(f"{root}/snapshots").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def _committed(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("status") == "ready").select("repository_id", F.col("id").alias("snapshot_id"), "attempt_id")


def read_ready(spark: SparkSession, root: str, name: str, keep: int = 2**31 - 1) -> DataFrame:
    """A table's rows of ready snapshots (the newest ``keep`` of a repository), as their last commit has them."""
    ready = _committed(retention(listed(spark, root), keep=keep))
    return _read(spark, f"{root}/{name}").join(ready, [*KEYS, "attempt_id"], "left_semi").drop("attempt_id")


def sweep(spark: SparkSession, root: str, name: str, keep: int = 2, running: Sequence[str] = ()) -> int:
    """Delete the folders of a table that no ready snapshot among the newest ``keep`` needs: retired, failed and broken-off attempts; how many.

    ``running``: attempts that are still being written.  One folder name for each of those deleted comes to the driver.
    """
    ready = _committed(retention(listed(spark, root), keep=keep))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    held = _read(spark, f"{root}/{name}").select(*KEYS, "attempt_id", folder.alias("folder")).distinct()
    gone = held.where(~F.col("attempt_id").isin(*running) if running else F.lit(True)).join(ready, [*KEYS, "attempt_id"], "left_anti")
    n = 0
    for row in gone.select("folder").toLocalIterator():
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row.folder))
        n += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def retention(snapshots: DataFrame, keep: int = 2) -> DataFrame:
    """The newest ``keep`` ready snapshots of a repository stay ready, older ready ones are retired."""
    newest = Window.partitionBy("repository_id", F.col("status") == "ready").orderBy(F.desc("created_at"), F.desc("id"))
    rank = F.row_number().over(newest)
    return snapshots.withColumn("__rank", rank).withColumn("status", F.when((F.col("status") == "ready") & (F.col("__rank") > keep), "retired").otherwise(F.col("status"))).drop("__rank")


def without_retired(table: DataFrame, snapshots: DataFrame) -> DataFrame:
    gone = snapshots.where(F.col("status") == "retired").select("repository_id", F.col("id").alias("snapshot_id"))
    return table.join(gone, KEYS, "left_anti")


def recover_interrupted(snapshots: DataFrame, failed_tasks: DataFrame) -> DataFrame:
    """Structured snapshots of failed tasks become failed."""
    hit = failed_tasks.select(F.col("snapshot_id").alias("id"), F.lit(True).alias("__hit")).distinct()
    lost = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") == "structured")
    return snapshots.join(hit, "id", "left").withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).select(*snapshots.columns)


def reusable_runs(snapshots: DataFrame, *settings: str) -> DataFrame:
    """For each repository and equal settings: the two newest ready snapshots, the older as full, the newer as incremental run."""
    keys = ["repository_id", *settings]
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    two = snapshots.where(F.col("status") == "ready").withColumn("__rank", F.row_number().over(newest)).where("__rank <= 2")
    pick = lambda n: F.max(F.when(F.col("__rank") == n, F.col("id")))
    return two.groupBy(*keys).agg(pick(2).alias("full_id"), pick(1).alias("incremental_id")).where("full_id is not null")
