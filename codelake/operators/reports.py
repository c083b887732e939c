"""Evaluation reports: writing them, and reading those that are well-formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import numbered, settle
from ..functions.text import col, identity

#: Fields that must be finite numbers.
QUALITY_FIELDS = ["recall@5", "recall@10", "recall@20", "mrr@10", "p50_ms", "p95_ms"]
INDEX_FIELDS = ["files", "chunks", "total_seconds", "peak_rss_bytes"]
_OBJECTS = ["summary", "hardware", "indexing"]


def read_report_files(spark: SparkSession, root: str) -> DataFrame:
    """path (under the root) and content of every results.json."""
    found = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "results.json").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/*", "")
    return found.select(F.replace(path, F.lit(base + "/"), F.lit("")).alias("path"), F.col("value").alias("content"))


def _numbers(entries: Column, fields: list[str]) -> Column:
    """Each entry is an object whose fields are finite numbers, written as such."""
    number = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"

    def sound(entry: Column) -> Column:
        out = F.schema_of_variant(entry).startswith("OBJECT")
        for name in fields:
            value = F.try_variant_get(entry, f"$['{name}']", "variant")
            kind = F.schema_of_variant(value)
            out = out & F.coalesce((kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")) & F.to_json(value).rlike(number), F.lit(False))
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.forall(F.map_values(entries), sound), F.lit(False))


def load_reports(files: DataFrame, content: Column | str = "content") -> DataFrame:
    """id, name, status, split, summary, hardware, indexing (without skip lists, with their lengths) of well-formed reports."""
    v = files.withColumn("v", F.try_parse_json(col(content)))
    part = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    objects = F.lit(True)
    for name in _OBJECTS:
        objects = objects & F.coalesce(F.schema_of_variant(part(name, "variant")).startswith("OBJECT"), F.lit(False))
    v = v.where(objects).withColumns({name: part(name, "map<string, variant>") for name in _OBJECTS})
    present = part("status", "variant").isNotNull() & part("split", "variant").isNotNull()
    good = v.where(present & _numbers(F.col("summary"), QUALITY_FIELDS) & _numbers(F.col("indexing"), INDEX_FIELDS))

    def counted(key: Column, entry: Column) -> Column:
        fields = F.try_variant_get(entry, "$", "map<string, variant>")
        kept = F.map_filter(fields, lambda k, _: k != "skipped")
        n = F.coalesce(F.size(F.try_variant_get(entry, "$.skipped", "array<variant>")), F.lit(0))
        return F.struct(F.transform_values(kept, lambda _, x: F.to_json(x)).alias("metrics"), F.greatest(n, F.lit(0)).alias("skipped_files"))

    return good.select(
        identity("path").alias("id"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("name"), part("status", "string").alias("status"), part("split", "string").alias("split"),
        F.transform_values("summary", lambda _, x: F.try_variant_get(x, "$", "map<string, double>")).alias("summary"),
        F.transform_values("hardware", lambda _, x: F.to_json(x)).alias("hardware"), F.transform_values("indexing", counted).alias("indexing"),
    )


def export_report(rows: DataFrame, summary: DataFrame, root: str) -> str:
    """Rows as CSV and JSON under the root; the summary (one row per strategy) as a Markdown table, returned as well."""
    rows.write.mode("overwrite").json(f"{root}/rows.json")
    flat = [c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{root}/rows.csv")
    table = summary.orderBy("strategy").collect()
    lines = ["| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    lines += ["| " + " | ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in table]
    text = "\n".join(lines) + "\n"
    summary.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{root}/report.md")
    return text


def labels_hash(labels: DataFrame, block: int = 1024) -> DataFrame:
    """labels_sha256: one hash over all labels in the order of their ids, as a tree.

    Labels are numbered in that order; the hashes of ``block`` neighbours, each on a line, are hashed together, and so on
    until one is left.  No task gets more than ``block`` of them.
    """
    text = F.to_json(F.struct(F.col("id"), *(c for c in sorted(labels.columns) if c != "id")))
    rows = numbered(labels.select("id", F.sha2(text, 256).alias("digest")), F.asc_nulls_first("id"), "digest", label="labels").select("pos", "digest")
    n = rows.count()
    if not n:
        return labels.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("labels_sha256"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), "\n")
        rows = settle(rows.groupBy(F.floor(F.col("pos") / block).alias("pos")).agg(F.sha2(joined, 256).alias("digest")), "labels")
        n = -(-n // block)
        if n == 1:
            return rows.select(F.col("digest").alias("labels_sha256"))
