"""Line dedup by a deletion-neighbourhood join, with built-in functions only.

A line goes if the same line, or one within one edited character, stands earlier (by document id, hash
of its text and line number, over all documents); so of every line its earliest form stays.  Lines of
fewer than ``min_chars`` characters always stay (that is the rule: they are no passages).  There is no
upper limit.

Equal lines are first brought to one.  Two lines are one edit apart only if, cut into parts by the
shorter one's length, they agree before and after one of the parts; lines that share no such frame with
another line are done.  For the others, all variants of the part with one character deleted are emitted
as hashed keys (with their frame), with the place of the deletion: equal variants with the same place
are one replacement apart, a variant that equals a whole part is one insertion apart.  Equal variants
are joined, each line with the earliest of its group only, and the edit distance of the pairs that would
remove a line is verified on their texts.  A part is a quarter of the line and up to three characters
more, of lines over ``PARTS * PART_CHARS`` characters under twice ``PART_CHARS``, so lines of any length
have few variants.

Scale: lines are counted with partial aggregation before anything is joined; hot lines and frames are
broadcast (``spread_join``); groups are never expanded to pairs; texts move once, keyed by document.

Edge cases: null texts have no lines and stay null; empty texts have one empty line, which stays; null
ids come last; rows of one id are told apart by their texts, and rows equal in id and text count as one
(they keep and lose the same lines); an empty table gives an empty result; further columns stay where
texts are rewritten, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join

PARTS, PART_CHARS = 4, 256


def _key(id_col: str, text_col: str, prefix: str = "") -> list[Column]:
    """What tells a document from others, in order."""
    return [F.col(id_col).isNull().alias(f"{prefix}no_id"), F.col(id_col).alias(f"{prefix}doc_id"), F.xxhash64(text_col).alias(f"{prefix}text_hash")]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}text_hash") == F.col(f"{b}text_hash"))


def _split(text_col: str) -> Column:
    return F.split(text_col, "\n", -1)


def _short(m: Column) -> Column:
    return m <= PARTS * PART_CHARS


def _parts(m: Column) -> Column:
    return F.when(_short(m), F.lit(PARTS)).otherwise(F.ceil(m / PART_CHARS)).cast("int")


def _after(m: Column, i: Column) -> Column:
    """How many whole parts, from the end of a long line, stand behind part i."""
    return F.greatest(F.lit(0), F.floor(m / PART_CHARS) - (i + 1)).cast("int")


def _bounds(m: Column, i: Column) -> tuple[Column, Column]:
    """What the frame of part i leaves open: of a short line a quarter, and up to three characters more; of a long one, part i and up to one more."""
    quarter, behind = F.shiftright(m, 2), F.lit(PARTS - 1) - i
    return F.when(_short(m), i * quarter).otherwise(i * PART_CHARS), m - F.when(_short(m), behind * quarter).otherwise(PART_CHARS * _after(m, i))


def _pieces(size: Column, n: Column) -> list[Column]:
    """Hashes of the first and of the last three pieces of so many characters; of bytes, where each is a character."""
    starts = [*(size * j + 1 for j in range(PARTS - 1)), *(n - size * j + 1 for j in range(PARTS - 1, 0, -1))]
    return [F.when(F.col("bytes").isNotNull(), F.xxhash64(F.substring("bytes", x, size))).otherwise(F.xxhash64(F.substring("line", x, size))) for x in starts]


def _framed(lines: DataFrame) -> DataFrame:
    """With frames: for both lengths that a pair may be measured by (the own one, one less), and each part, what stands before and after it.

    Each of a short line's pieces is cut and hashed once, and its frames are made of these hashes; the pieces of both lengths are the same in three cases of four.
    """
    n, less = F.col("n"), F.col("n") - 1
    own, other = [f"own_{j}" for j in range(2 * PARTS - 2)], [f"other_{j}" for j in range(2 * PARTS - 2)]
    rows = lines.withColumn("n", F.length("line"))
    rows = rows.withColumn("bytes", F.when(F.octet_length("line") == n, F.col("line").cast("binary")))
    rows = rows.withColumns({k: F.when(_short(less), x) for k, x in zip(own, _pieces(F.shiftright(n, 2), n), strict=True)})
    same = (F.shiftright(less, 2) == F.shiftright(n, 2)) | ~_short(less)
    rows = rows.withColumns({k: F.when(same, F.col(x)).otherwise(y) for k, x, y in zip(other, own, _pieces(F.shiftright(less, 2), n), strict=True)})
    pieces = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0)), lambda y: F.xxhash64(y))
    once = F.array(F.struct(pieces(F.col("line")).alias("front"), pieces(F.reverse("line")).alias("back")))  # cut once, not in each step

    def short(m: Column, names: list[str]) -> Column:
        return F.array(*(F.xxhash64(F.lit(i), m, *names[:i], *names[PARTS - 1 + i :]) for i in range(PARTS)))

    def long(m: Column, c: Column) -> Column:
        frame = lambda i: F.xxhash64(i, m, F.slice(c["front"], 1, i), F.slice(c["back"], 1, _after(m, i)))
        return F.transform(F.sequence(F.lit(0), _parts(m) - 1), frame)

    both = lambda c: F.concat(F.when(_short(n), short(n, own)).otherwise(long(n, c)), F.when(_short(less), short(less, other)).otherwise(long(less, c)))
    frames = F.when(_short(n), F.concat(short(n, own), short(less, other))).otherwise(F.flatten(F.transform(once, both)))
    return rows.withColumn("frames", frames).drop("n", "bytes", *own, *other)


def _variants(frame: Column, middle: Column, start: Column, role: Column) -> Column:
    """(variant, place, at): the part without each of its characters (the place counts if lengths are equal), and the whole part of the shorter."""
    size = F.length(middle)
    deleted = lambda p: F.xxhash64(frame, F.concat(F.substring(middle, F.lit(1), p - 1), F.substring(middle, p + 1, size)))
    gone = F.transform(F.sequence(F.lit(1), size), lambda p: F.struct(deleted(p).alias("variant"), F.when(role == 0, p).otherwise(-1).alias("place"), (start + p).alias("at")))
    whole = F.array(F.struct(F.xxhash64(frame, middle).alias("variant"), F.lit(0).alias("place"), F.lit(0).alias("at")))
    return F.when(role == 0, F.concat(gone, whole)).otherwise(gone)


def _without(line: str, at: Column) -> Column:
    return F.concat(F.substring(F.col(line), F.lit(1), at - 1), F.substring(F.col(line), at + 1, F.length(line)))


def near_lines(docs: DataFrame, distinct: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """h of the distinct lines that have an earlier line one edit apart."""
    framed = distinct.select("h", F.posexplode("frames").alias("at", "frame"))
    shared = materialise(framed.groupBy("frame").agg(F.count("*").alias("k")).where("k > 1"), "shared-frames")
    open_ = materialise(spread_join(framed, shared, "frame", "k").select("h", "at", "frame"), "line-frames")
    wanted = distinct.join(open_.select("h").distinct(), "h", "left_semi").select("h", "first")
    places = wanted.groupBy(F.col("first.doc_id").alias("w_doc_id"), F.col("first.text_hash").alias("w_text_hash")).agg(F.collect_list(F.struct("h", "first")).alias("wanted"))
    texts = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")).join(places, _same("", "w_"))
    picked = F.transform(F.array(_split("text")), lambda ls: F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), w["first"].alias("first"), ls[w["first"]["pos"]].alias("line"))))
    found = texts.select(F.explode(F.flatten(picked)).alias("w")).select("w.*")  # each text is split once
    found = materialise(found.dropDuplicates(["h"]), "open-lines")
    n = F.length("line")
    role = F.when(F.col("at") >= _parts(n), 1).otherwise(0)
    opened = found.join(open_, "h").withColumn("role", role)
    m = n - F.col("role")
    a, b = _bounds(m, F.col("at") - F.when(F.col("role") == 1, _parts(n)).otherwise(0))
    opened = opened.select("h", "first", "frame", "role", a.alias("start"), F.substring(F.col("line"), a + 1, b - a + F.col("role")).alias("middle"))
    rows = opened.select("h", "first", F.explode(_variants(F.col("frame"), F.col("middle"), F.col("start"), F.col("role"))).alias("v")).select("h", "first", "v.*")
    rows = rows.withColumn("slot", F.greatest("place", F.lit(0)))
    mine = F.struct("first", "h", "at")
    best = rows.groupBy("variant", "slot").agg(
        F.count("*").alias("k"),
        F.min(F.when(F.col("place") > 0, mine)).alias("replaced"),
        F.min(F.when(F.col("place") == 0, mine)).alias("shorter"),
        F.min(F.when(F.col("place") < 0, mine)).alias("longer"),
    )
    joined = rows.join(best.where("k > 1"), ["variant", "slot"])
    other = F.when(F.col("place") > 0, F.col("replaced")).when(F.col("place") == 0, F.col("longer")).otherwise(F.col("shorter"))
    pairs = joined.select("h", "first", "place", "at", other.alias("other")).where("other is not null and other.first < first")
    pairs = pairs.groupBy("h").agg(F.min(F.struct("other", "place", "at")).alias("p")).select("h", F.col("p.other.h").alias("g"), F.col("p.other.at").alias("other_at"), "p.place", "p.at")
    own, early = found.select("h", "line"), found.select(F.col("h").alias("g"), F.col("line").alias("earlier"))
    verified = (  # one edit apart: equal without the character at a known place, which takes one pass over lines of any length
        F.when(F.col("place") > 0, (_without("line", F.col("at")) == _without("earlier", F.col("at"))) & (F.length("line") == F.length("earlier")))
        .when(F.col("place") < 0, _without("line", F.col("at")) == F.col("earlier"))
        .otherwise(F.col("line") == _without("earlier", F.col("other_at")))
    )
    return pairs.join(own, "h").join(early, "g").where(verified).select("h")


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 16) -> DataFrame:
    """no_id, doc_id, text_hash, exact and near: the line numbers (from 0) that go, for documents that have any."""
    lines = docs.select(*_key(id_col, text_col), F.posexplode(_split(text_col)).alias("pos", "line")).where(F.length("line") >= min_chars)
    place = F.struct("no_id", "doc_id", "text_hash", "pos")
    seen = _framed(lines).select("no_id", "doc_id", "text_hash", "pos", F.xxhash64("line").alias("h"), "frames")
    distinct = seen.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("frames").alias("frames"))
    distinct = materialise(distinct, "distinct-lines")
    near = near_lines(docs, distinct, id_col=id_col, text_col=text_col).withColumn("near", F.lit(True))
    marked = distinct.select("h", "first", "n").join(near, "h", "left").where("n > 1 or near").select("h", "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    marked = materialise(marked, "marked-lines")
    again = spread_join(seen.drop("frames"), marked, "h", "n").withColumn("is_first", place.eqNullSafe(F.col("first"))).where("near or not is_first")
    return again.groupBy("no_id", "doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_first"), F.col("pos")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(F.col("is_first"), F.col("pos")))).alias("near"),
    )


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """Per document: lines, those that go as equal or as near, and those that stay."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **rule).select(F.col("doc_id").alias("g_doc_id"), F.col("text_hash").alias("g_text_hash"), "exact", "near")
    counted = docs.select(*_key(id_col, text_col), F.coalesce(F.size(_split(text_col)), F.lit(0)).alias("n_lines"))
    exact, near = F.coalesce(F.size("exact"), F.lit(0)), F.coalesce(F.size("near"), F.lit(0))
    return counted.join(gone, _same("", "g_"), "left").select("doc_id", "n_lines", exact.alias("equal_lines"), near.alias("near_lines"), (F.col("n_lines") - exact - near).alias("kept_lines"))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """The documents with their texts' repeated lines taken out; all documents and columns stay."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **rule)
    gone = gone.select(F.struct("doc_id", "text_hash", F.array_union("exact", "near").alias("lines")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    same = F.col("row").getField(id_col).eqNullSafe(F.col("gone.doc_id")) & (F.xxhash64(text) == F.col("gone.text_hash"))
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone.lines", i))
    cut = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    joined = rows.join(gone, same, "left").withColumn("cut", cut)
    return joined.select(*(F.col("cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
