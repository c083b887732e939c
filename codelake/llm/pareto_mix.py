"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by weight, limited to ``max_copies`` times their own words, the excess
reshared.  Inside a source every document has an expected number of copies whose word-weighted
mean is target / source words; longer documents get somewhat fewer, so that single draws weigh
less.  The whole part is allocated for certain.  The fraction p is an inclusion probability:
documents are ranked by (u / (1 - u)) / (p / (1 - p)), u uniform from id and text, and taken in that
order until the words left over by the whole copies are reached (the sample has a fixed size in
words).  In the stretch of the order where the limit falls, documents that would overshoot are
passed over, and one more is taken if that ends nearer to the target.

Scale: one narrow pass for sizes, one row per source, and rank buckets of about ``bucket_rows``
documents; only the bucket in which a source's limit falls is ordered, whatever the source's size.

Edge cases: null text counts 0 words and is never taken; a null source is a source of its own,
ranked last; repeated rows share their draw and count separately; an empty table gives an empty
result; further columns pass through.  Columns named like an output (size, source_size, target,
copies, taken) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, uniform, word_count

_KEY = ["__no_source", "__source"]
OUTPUTS = ["size", "source_size", "target", "copies", "taken"]


def _keyed(docs: DataFrame, source_col: str) -> DataFrame:
    return docs.withColumns({_KEY[0]: F.col(source_col).isNull(), _KEY[1]: F.coalesce(source_col, F.lit(""))})


def _lightness() -> F.Column:
    """In (0, 1]; smaller for longer documents."""
    return 1.0 / (1.0 + F.col("size") / 256.0)


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """One row per source: words, weight and target words."""
    per_source = sizes.groupBy(*_KEY).agg(
        F.sum("size").alias("source_size"),
        F.count("*").alias("n_docs"),
        F.sum(F.col("size") * _lightness()).alias("light_words"),
    )
    whole, by_name = Window.partitionBy(), Window.orderBy(*_KEY)
    by_ratio = Window.orderBy("ratio", *_KEY).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = (
        per_source.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * float(max_copies))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("free_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("free_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.col("free_words") / F.col("free_weight"))
    )
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return ranked.withColumn("target", F.least("most", F.coalesce(F.col("weight") * level, F.col("most")))).select(
        *_KEY, "source_size", "n_docs", "light_words", "target"
    )


def _expected(sized: DataFrame, targets: DataFrame, id_col: str, max_copies: int, tilt: float, seed: int, bucket_rows: int) -> DataFrame:
    """Adds whole copies, the rank of the fraction and its bucket."""
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    mean_light = F.when(F.col("source_size") > 0, F.col("light_words") / F.col("source_size")).otherwise(0.0)
    copies = F.when(
        F.col("size") > 0,
        F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), rate + tilt * F.least(rate, max_copies - rate) * (_lightness() - mean_light))),
    ).otherwise(0.0)
    joined = sized.join(targets, _KEY)
    out = joined.withColumn("__copies", F.round(copies, 9)).withColumn("__whole", F.floor("__copies"))
    odds = lambda p: p / (1.0 - p)
    p = F.col("__copies") - F.col("__whole")
    out = out.withColumn("__rank", F.when(p > 0, odds(uniform(seed, id_col, "__tie")) / odds(p)))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / float(bucket_rows)))
    place = F.col("__rank") / (1.0 + F.col("__rank"))
    return out.withColumn("__bucket", F.least(buckets - 1, F.floor(place * buckets)))


def _limits(ranked: DataFrame) -> DataFrame:
    """Per source: the bucket in which the sample ends, and the words still free before it."""
    left = (F.first("target") - F.sum(F.col("__whole") * F.col("size"))).alias("left")
    free = ranked.groupBy(*_KEY).agg(left)
    sums = ranked.where("__bucket is not null").groupBy(*_KEY, "__bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*_KEY).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(free, _KEY)
        .where(F.col("before") + F.col("words") > F.col("left"))
        .groupBy(*_KEY)
        .agg(F.min_by(F.struct(F.col("__bucket").alias("at"), (F.col("left") - F.col("before")).alias("room")), "__bucket").alias("end"))
    )
    return free.join(ends, _KEY, "left").select(*_KEY, F.coalesce("end.at", F.lit(1 << 60)).alias("__end"), F.coalesce("end.room", F.lit(0.0)).alias("__room"))


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["__rank", "__id", "__tie"], kind="stable").reset_index(drop=True)
    room, extra = float(rows["__room"].iloc[0]), [0] * len(rows)
    for i, size in enumerate(rows["size"]):
        if size <= room:
            extra[i] = 1
            room -= size
    rest = [(abs(size - room), i) for i, size in enumerate(rows["size"]) if not extra[i]]
    if rest and min(rest)[0] < room:
        extra[min(rest)[1]] = 1
    rows["__extra"] = extra
    return rows


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_copies: int = 3,
    tilt: float = 0.5,
    seed: int = 20,
    bucket_rows: int = 1024,
    keep_text: bool = True,
) -> DataFrame:
    """The documents with size, source_size, target, copies and taken (copies times size)."""
    docs = docs.drop(*(c for c in OUTPUTS if c in docs.columns))
    sized = _keyed(docs, source_col).withColumn("size", word_count(text_col)).withColumn("__tie", F.xxhash64(text_col))
    narrow = materialise(sized.select(F.col(id_col).alias("__id"), "__tie", *_KEY, "size"), "mix-sizes")
    if not keep_text:
        sized = narrow.select(F.col("__id").alias(id_col), "__id", "__tie", *_KEY, "size")
    else:
        sized = sized.withColumn("__id", F.col(id_col))
    targets = materialise(source_targets(narrow, weights, max_copies), "mix-targets")
    expected = lambda df: _expected(df, targets, "__id", max_copies, tilt, seed, bucket_rows)
    limits = materialise(_limits(expected(narrow)), "mix-limits")
    ranked = expected(sized).join(limits, _KEY)
    inside = F.coalesce(F.col("__bucket") < F.col("__end"), F.lit(False)).cast("int")
    clear = ranked.where(~F.coalesce(F.col("__bucket") == F.col("__end"), F.lit(False))).withColumn("__extra", inside)
    at_end = ranked.where(F.col("__bucket") == F.col("__end"))
    schema = clear.select(*at_end.columns, F.col("__extra").cast("int")).schema
    done = clear.select(*schema.names).unionByName(at_end.groupBy(*_KEY).applyInPandas(_fill, schema))
    copies = (F.col("__whole") + F.col("__extra")).cast("long")
    return done.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(
        *(c for c in sized.columns if not c.startswith("__") and c != "size"), *OUTPUTS
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    kept = docs.select(F.struct("*").alias("whole_row"), *(F.col(options.get(c, d)).alias(d) for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))))
    taken = mix(kept, **{k: v for k, v in options.items() if not k.endswith("_col")}).where("copies > 0")
    return taken.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")
