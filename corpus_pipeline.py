"""From documents to packed training windows: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its
columns.  Null or empty texts, ties, repeated rows, empty tables and further columns are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import best_fit, line_dedup, pareto_mix, simhash, toxicity
from codelake.llm.common import fresh_path, materialise, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars again, where a stage has rewritten the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the machine learns from the labels of ``sf_dir``.

    Null, empty and wordless texts stay; without labels of both classes all stay; repeated rows and null ids are scored
    like others; further columns stay, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct("*").alias("row")), model, text_col="row.text", keep=True)
    return scored.where("toxicity_score < 0.5").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, or one character apart from an earlier one, go; documents stay.

    Null texts stay null; rows of one id are told apart by their texts; rows equal in both keep and lose the same lines.
    """
    return _measured(line_dedup.without_repeated_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id (of equal ids, that with the smallest text hash) stays, once.

    Null and empty texts are alike; null ids stay only where the group has no other; rows that are equal in id and text
    count as one; further columns stay, whatever their names.
    """
    groups = materialise(simhash.similar_documents(docs), "groups")
    leads = F.col("leader").eqNullSafe(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    kept = groups.where(leads).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).select(F.struct("doc_id", "text_hash", "n").alias("kept"))
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept.doc_id")) & (F.xxhash64("row.text") == F.col("kept.text_hash"))
    found = rows.join(kept, same)
    if kept.where("kept.n > 1").isEmpty():
        return found.select("row.*")
    once = found.where("kept.n > 1").groupBy("kept").agg(F.first("row").alias("row")).select("row.*")
    return found.where("kept.n = 1").select("row.*").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and wordless texts are never taken; a null source is one of its own; repeated rows count separately.
    """
    return pareto_mix.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows; copies of a document never share one.

    Null and wordless texts have no pieces; null ids and repeated rows are packed like others.
    """
    return best_fit.pack(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("dedup_lines", dedup_lines),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL can train no string kernel; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
