"""Document fingerprints by winnowing, with built-in functions only.

A text is cut into words; every k words in a row give a rolling hash (runs of 1, 2, 4, ... words are
combined, so each step covers all places at once), and of every ``window`` hashes in a row the smallest
is chosen, of equal ones the rightmost.  A choice is kept as one number, hash above and position below,
so the smaller number is the smaller hash and then the later position, and a sliding minimum takes
log2(window) passes.  Two texts that share window + k - 1 words in a row share a fingerprint hash,
whatever stands around them.

A word is a run of up to ``WORD_CHARS`` letters or digits of scripts that put spaces between words; any
other visible character is a word of its own, and so is each character of a longer run, up to its last
``WORD_CHARS``.  So where a word ends depends on nothing but the characters around it: in text without
spaces, too, words fall in step again behind an insertion, and the guarantee holds in characters.

Neighbours: ``with_neighbour`` gives each document its predecessor by id (the smallest id gets the
largest).  Documents meet in buckets of ids that lie together, about ``BUCKET`` each if ids are spread
evenly over their range, dense or sparse; rows without id have buckets of their own, by text hash.  Only
each bucket's first document asks another bucket.  Texts are shuffled twice by bucket, for the documents
and for the last ones of the buckets.

Edge cases: null text counts as empty; empty texts have no hashes and are alike to each other (1.0);
texts of fewer than k words have one hash of all words; a window longer than the text is the text;
equal ids are ordered by a hash of the text (rows of one id share a bucket); null ids come before all
others; one document is its own neighbour; an empty table gives an empty result; further columns are
left out.  Positions are exact up to word 2^26 - 1; later ones count as that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_CHARS = 24
POSITION_BITS = 26
BUCKET = 128
_LETTER = r"0-9A-Za-z\u00AA-\u02FF\u0370-\u0DFF"
_WORD = rf"[{_LETTER}]{{1,{WORD_CHARS}}}+(?![{_LETTER}])|[^\x20\x09-\x0D]"
_LAST = (1 << POSITION_BITS) - 1


def _pairs(a: Column, b: Column, shift: int, f) -> Column:
    """f over a[i], b[i + shift], as far as both reach."""
    n = F.greatest(F.lit(0), F.least(F.size(a), F.size(b) - shift))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + shift, n), f)


def _runs(n: int) -> list[tuple[str, str, str, int]]:
    """(name, left, right, shift): what to combine for runs of n, from runs of powers of two; r1 are single ones."""
    steps, span = [], 1
    while 2 * span <= n:
        steps.append((f"r{2 * span}", f"r{span}", f"r{span}", span))
        span *= 2
    done = span
    while done < n:
        part = 1 << (n - done).bit_length() - 1
        steps.append((f"r{done + part}", f"r{done}", f"r{part}", done))
        done += part
    return steps


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = 5, window: int = 8) -> DataFrame:
    """Adds ``out``: the chosen numbers, (37 bits of hash, 26 of position) each, by first choice."""
    if k < 1 or window < 1:
        raise ValueError("k and the window are 1 at least")
    keep = [x for x in df.columns if x != out]
    c = lambda name: F.col(f"__{name}")

    def add(df: DataFrame, name: str, col: Column, drop: list[str]) -> DataFrame:
        return df.withColumn(f"__{name}", col).drop(*(f"__{x}" for x in drop if x != name))

    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(_WORD), F.lit(0))
    df = add(df, "r1", F.transform(words, lambda t: F.xxhash64(t)), [])
    steps = _runs(k)
    for name, left, right, shift in steps:
        df = add(df, name, _pairs(c(left), c(right), shift, lambda a, b: F.xxhash64(a, b)), [])
    runs = list(dict.fromkeys(["r1", *(s[0] for s in steps)]))
    grams = F.when(F.size(c("r1")) >= k, c(runs[-1])).when(F.size(c("r1")) > 0, F.array(F.xxhash64(c("r1")))).otherwise(F.array().cast("array<bigint>"))
    ranked = F.transform(grams, lambda x, i: F.shiftleft(x.bitwiseAND((1 << 37) - 1), POSITION_BITS).bitwiseOR(F.lit(_LAST) - F.least(i, F.lit(_LAST)).cast("long")))
    df = add(df, "m", ranked, runs).withColumnRenamed("__m", "__r1")
    span, last = 1, "r1"
    while 2 * span <= window:
        df = add(df, f"r{2 * span}", _pairs(c(last), c(last), span, lambda x, y: F.least(x, y)), [])
        span, last = 2 * span, f"r{2 * span}"
    least = c(last) if span == window else _pairs(c(last), c(last), window - span, lambda x, y: F.least(x, y))
    chosen = F.when(F.size(c("r1")) >= window, F.array_distinct(least)).when(F.size(c("r1")) > 0, F.array(F.array_min(c("r1")))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*keep, chosen.alias(out))


def hashes(fingerprint: Column | str) -> Column:
    """The distinct hashes, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, POSITION_BITS)))


def positions(fingerprint: Column | str) -> Column:
    """Where the chosen k-grams begin, in words from 0."""
    return F.transform(fingerprint, lambda v: F.lit(_LAST) - v.bitwiseAND(_LAST))


def digest(fingerprint: Column | str) -> Column:
    """32 hex digits over all chosen hashes and positions."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(fingerprint)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), fingerprint)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Common hashes by all hashes of two sets; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _previous(keys: DataFrame, span: int = 1024) -> DataFrame:
    """b, p: each key and the next smaller one, the largest for the smallest; the upper level has a 1024th of the keys in one task."""
    parent = F.floor(F.col("b") / span)
    inner = keys.withColumn("u", parent)
    tops = inner.groupBy("u").agg(F.max("b").alias("top"))
    by_top = Window.orderBy("u")
    tops = tops.select("u", F.coalesce(F.lag("top").over(by_top), F.max("top").over(Window.partitionBy())).alias("before"))
    return inner.withColumn("q", F.lag("b").over(Window.partitionBy("u").orderBy("b"))).join(tops, "u").select("b", F.coalesce("q", "before").alias("p"))


def with_neighbour(docs: DataFrame, id_col: str, text_col: str, k: int = 5, window: int = 8) -> DataFrame:
    """doc_id, text, fp, next_id, next_text and next_hashes: the document before, by id."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n, ids, low, high = docs.agg(F.count("*"), F.count(id_col), F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    span = max(1, ((high or 0) - (low or 0) + 1) * BUCKET // max(1, ids))
    part = F.shiftrightunsigned("__tie", 1).cast("double") / float(1 << 63)
    without = -F.lit(1 + (n - ids) // BUCKET) + F.floor(part * (1 + (n - ids) // BUCKET))
    base = base.withColumn("__tie", F.xxhash64("text"))
    base = base.withColumn("b", F.when(F.col("doc_id").isNull(), without).otherwise(F.floor((F.col("doc_id").cast("decimal(38,0)") - (low or 0)) / span)).cast("long"))
    # the order of ties is that of unsigned hashes, as in the buckets
    w = Window.partitionBy("b").orderBy(F.asc_nulls_first(F.col("doc_id").cast("long")), F.shiftrightunsigned("__tie", 1), "__tie")
    placed = base.withColumn("__n", F.row_number().over(w)).withColumn("next_text", F.lag("text").over(w)).withColumn("next_id", F.lag("doc_id").over(w))
    placed = placed.withColumn("__end", F.lead("__n").over(w).isNull())
    own = with_fingerprint(placed, "text", "fp", k, window)
    inside = own.withColumn("next_hashes", F.lag(hashes("fp")).over(w)).where(F.col("__n") > 1).select("doc_id", "text", "fp", "next_id", "next_text", "next_hashes")
    last = placed.where("__end").select(F.col("b").alias("p"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    guests = _previous(base.select("b").distinct()).join(last, "p").select("b", "next_id", "next_text")
    first = placed.where(F.col("__n") == 1).select("b", "doc_id", "text").join(guests, "b")
    first = with_fingerprint(with_fingerprint(first, "text", "fp", k, window), "next_text", "__next", k, window)
    first = first.select("doc_id", "text", "fp", "next_id", "next_text", hashes("__next").alias("next_hashes"))
    return inside.unionByName(first)


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 8) -> DataFrame:
    """Each document's fingerprint against that of its text with the second half overwritten by its neighbour's beginning."""
    df = with_neighbour(docs, id_col, text_col, k, window)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    df = df.select("doc_id", "next_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_hashes")
    df = with_fingerprint(df, "edited", "edited_fp", k, window)
    df = df.withColumn("own", hashes("fp")).withColumn("other", hashes("edited_fp"))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest("fp").alias("fingerprint"),
        digest("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
        F.size("fp").alias("chosen"),
        "next_id",
    )
