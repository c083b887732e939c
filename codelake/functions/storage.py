"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one, in local mode alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codelake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to four tasks a core at least, before work in which a row costs far more than its bytes: a file of
    input is a few splits, however long its rows take, and would keep as many cores busy."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos", label: str = "numbered") -> DataFrame:
    """The rows, stored in the order given, with their place in it: 0, 1, 2 ... without gaps.

    Rows are dealt by ranges of the order, so no key is too hot unless all of the order is equal; one number per
    partition comes to the driver.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    stored = settle(spread, label)
    part = F.shiftrightunsigned("__at", 33)
    first, offsets = 0, []
    for p, n in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((p, first))
        first += n
    known = rows.sparkSession.createDataFrame(offsets, "__part long, __first long")
    placed = stored.withColumn("__part", part).join(F.broadcast(known), "__part")
    return placed.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__first")
