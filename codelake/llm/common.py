"""What the operators of this subpackage share: shared storage, word rule, stable randomness."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import fresh_path, numbered, settle, shared_dir  # noqa: F401

materialise = settle

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem_of(uri: str):
    """Where tasks write and read files of their own: pyarrow's file system, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else "file://" + uri)


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number inside (0, 1) that depends on the values and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def id_remainder(col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")) % modulus


def spread_join(rows: DataFrame, found: DataFrame, key: str, n_col: str) -> DataFrame:
    """Inner join with a stored table that has one row per key, and the key's number of rows in ``n_col``.

    Keys with over a thousandth of all rows are fewer than a thousand: they are broadcast, so that no
    task gets a hot key.  The others meet by a shuffle.
    """
    total = found.agg(F.sum(n_col)).first()[0] or 0
    hot = found.where(F.col(n_col) > max(total / 1000, 1000))
    if hot.isEmpty():
        return rows.join(found.drop(n_col), key)
    cold = found.where(F.col(n_col) <= max(total / 1000, 1000))
    few = F.broadcast(hot.drop(n_col))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop(n_col), key))


def agreed_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id and y: one row per id that has labels 0 or 1, all the same; ids with both are left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    per_id = known.groupBy("doc_id").agg(F.min(label_col).alias("y"), F.max(label_col).alias("__most"))
    return per_id.where("y = __most").select("doc_id", F.col("y").cast("int").alias("y"))
