"""How the sources of a language differ in their words: an audit over a K-squared quadtree of counts.

Terms that ``least_docs`` documents of a language have at least are its columns, its sources are the
rows, and cells are counts.  A cell's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the
row's sum and V the number of columns; two shares differ by floor((p - q)^2 / (p + q)).  Every source
is compared with every other (the sum over all columns) and with its whole language (column by column).

The matrix is cut into tiles of ``ROWS`` sources and ``COLUMNS`` terms.  A tile is a quadtree: each
square is split into four until it has ``LEAF`` rows and columns; squares without counts are not kept.
The trees of two bands of sources over the same columns are traversed together: where both squares are
empty the traversal turns back, where one has counts it goes on to the leaves, whose columns are
compared for all pairs of their rows at once.  In empty squares all columns are alike, so what is left
over for a pair, V less the columns seen, costs the difference of the two shares of count 0 each.

Scale: terms are counted per batch of documents before any shuffle, so a hot source or language moves
its vocabulary, not its words.  A task takes two bands over one stripe of columns (2 ROWS x COLUMNS
cells at most); cells are copied once for each band of sources of their language.  All arithmetic is
in integers, exact while a language has under 9 * 10^15 words.

Edge cases: null texts, languages and sources are empty strings; a source without terms is compared as
zeros; a language without kept terms has pairs of value 0 and no terms; equal values are ordered by
the item's bytes; repeated rows are documents of their own; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

#: Letters a term is made of: A to Z, a to z, and whatever is not ASCII, as UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE, ROWS, COLUMNS, LEAF = 1_000_000_000, 64, 4096, 32
_FLUSH, _DOC = 1 << 19, 1 << 36


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    groups: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)  # places, and documents times _DOC

    def flush() -> pd.DataFrame:
        parts = [pd.DataFrame({"lang": "", "source": "", "term": [], "n": [], "n_docs": []})]
        for (lang, source), found in groups.items():
            both = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            parts.append(pd.DataFrame({"lang": lang, "source": source, "term": [t.decode("utf-8", "replace") for t in found], "n": both % _DOC, "n_docs": both // _DOC}))
        groups.clear()
        return pd.concat(parts)

    for frame in frames:
        for lang, source, text in frame.itertuples(index=False):
            found = groups[lang, source]
            known = found.get
            for t, n in Counter(TERM.findall(text.lower())).items():  # of bytes: A to Z alone
                found[t] = known(t, 0) + n + _DOC
            if sum(map(len, groups.values())) > _FLUSH:
                yield flush()
    yield flush()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, its places there (n) and its documents (n_docs)."""
    plain = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    rows = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInPandas(_count, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, columns: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 columns)), in whole numbers."""
    large = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", large(F.lit(SCALE)) * large(n + 2), large(F.greatest(total + 2 * columns, F.lit(1)))) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same for an array of counts and what each row's are divided by; three decimal digits at a time, so that nothing overflows."""
    rest, found = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // totals[:, None], rest % totals[:, None]
    return found + 1


class QuadTree:
    """Counts of a tile: the squares that have any, by level, and the leaves."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray):
        self.leaves: dict[tuple[int, int], np.ndarray] = {}
        for r, c, n in zip(rows.tolist(), columns.tolist(), counts.tolist(), strict=True):
            leaf = self.leaves.setdefault((r // LEAF, c // LEAF), np.zeros((LEAF, LEAF), dtype=np.int64))
            leaf[r % LEAF, c % LEAF] = n
        self.filled = [set(self.leaves)]
        while len(self.filled) < (COLUMNS // LEAF).bit_length():
            self.filled.append({(r // 2, c // 2) for r, c in self.filled[-1]})


class Comparison:
    """Two bands of rows over the same columns, traversed together; ``totals`` are what their counts are divided by."""

    def __init__(self, a: QuadTree, b: QuadTree, a_totals: np.ndarray, b_totals: np.ndarray, columns: int):
        self.trees, self.totals, self.columns = (a, b), (a_totals, b_totals), columns
        self.values = np.zeros((len(a_totals), len(b_totals)), dtype=np.int64)
        self.seen = np.zeros_like(self.values)

    def visit(self, level: int, at: int, other: int, column: int) -> None:
        """Squares of rows ``at`` and ``other`` over the columns of square ``column``."""
        if not any((r, column) in t.filled[level] for t, r in zip(self.trees, (at, other), strict=True)):
            return  # nothing but zeros: left over for the price of all such columns
        if any((r * LEAF) << level >= len(n) for r, n in zip((at, other), self.totals, strict=True)):
            return  # below the last row
        if level:
            for i in range(8):
                self.visit(level - 1, 2 * at + (i & 1), 2 * other + (i >> 1 & 1), 2 * column + (i >> 2))
            return
        width, shares = min(LEAF, self.columns - column * LEAF), []
        for tree, r, totals in zip(self.trees, (at, other), self.totals, strict=True):
            own = totals[r * LEAF : (r + 1) * LEAF]
            counts = tree.leaves.get((r, column), np.zeros((LEAF, LEAF), dtype=np.int64))
            shares.append(_shares(counts[: len(own), :width], own))
        p, q = shares[0][:, None, :], shares[1][None, :, :]
        rows = np.s_[at * LEAF : at * LEAF + len(shares[0]), other * LEAF : other * LEAF + len(shares[1])]
        self.values[rows] += ((p - q) ** 2 // (p + q)).sum(2)
        self.seen[rows] += width


_TILE = ["lang", "a", "b", "stripe"]
_FOUND = "lang string, g long, h long, value long, seen long"


def _compare(key: tuple, cells: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
    lang, a, b, _ = key
    trees = {}
    for band in {a, b}:
        own = cells[cells["g"] // ROWS == band]
        trees[band] = QuadTree(own["g"].to_numpy() % ROWS, own["j"].to_numpy() % COLUMNS, own["n"].to_numpy())
    (row,) = bands.itertuples()
    met = Comparison(trees[a], trees[b], np.asarray(row.a_totals, dtype=np.int64), np.asarray(row.b_totals, dtype=np.int64), int(row.width))
    met.visit(len(trees[a].filled) - 1, 0, 0, 0)
    g, h = np.nonzero(met.seen)
    out = pd.DataFrame({"lang": lang, "g": g + a * ROWS, "h": h + b * ROWS, "value": met.values[g, h], "seen": met.seen[g, h]})
    return out[out["g"] < out["h"]]


def _pairs(cells: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value for every source and each other of its language.  groups: lang, g, source, total, n_groups, columns."""
    bands = F.floor((F.col("n_groups") - 1) / ROWS)
    band = F.floor(F.col("g") / ROWS)
    placed = cells.select("lang", "g", "j", "n", F.floor(F.col("j") / COLUMNS).alias("stripe"), F.explode(F.sequence(F.lit(0).cast("long"), bands)).alias("with"), band.alias("band"))
    tiles = materialise(placed.select("lang", F.least("band", "with").alias("a"), F.greatest("band", "with").alias("b"), "stripe", "g", "j", "n"), "tiles")
    by_band = groups.groupBy("lang", band.alias("band")).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", (F.col("total") + 2 * F.col("columns")).alias("d")))), lambda x: x["d"]).alias("totals"))  # of ROWS at most
    by_band = materialise(by_band, "bands")
    side = lambda x: by_band.select("lang", F.col("band").alias(x), F.col("totals").alias(f"{x}_totals"))
    known = tiles.select(*_TILE).distinct().join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).join(langs.select("lang", "columns"), "lang")
    width = F.least(F.lit(COLUMNS), F.col("columns") - F.col("stripe") * COLUMNS)
    known = known.select(*(F.col(c).alias(f"of_{c}") for c in _TILE), "a_totals", "b_totals", width.alias("width"))
    found = tiles.groupBy(*_TILE).cogroup(known.groupBy(*(f"of_{c}" for c in _TILE))).applyInPandas(_compare, _FOUND)
    sums = found.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    ask = groups.select("lang", "source", F.col("g").alias("x"), F.col("total").alias("p_total"), "columns", F.explode(F.sequence(F.lit(0).cast("long"), bands)).alias("band"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("y"), F.col("total").alias("q_total"), band.alias("band"))
    both = ask.join(other, ["lang", "band"]).where("x <> y").withColumns({"g": F.least("x", "y"), "h": F.greatest("x", "y")})
    zero = F.lit(0).cast("long")
    empty = difference(share(zero, F.col("p_total"), F.col("columns")), share(zero, F.col("q_total"), F.col("columns")))
    rest = F.col("columns") - F.coalesce("seen", zero)
    return both.join(sums, ["lang", "g", "h"], "left").select("lang", "source", "item", (F.coalesce("value", zero) + rest * empty).alias("value"))


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = materialise(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    kept = materialise(numbered(kept, "lang", "term", label="terms"), "terms")
    plain = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    present = docs.select(plain(lang_col, "lang"), plain(source_col, "source")).distinct()
    of_lang = kept.groupBy("lang").agg(F.min("pos").alias("first"), F.count("*").alias("columns"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    langs = present.groupBy("lang").agg(F.count("*").alias("n_groups")).join(of_lang, "lang", "left")
    langs = materialise(langs.select("lang", "n_groups", *(F.coalesce(c, zero).alias(c) for c in ("first", "columns", "lang_total"))), "langs")
    columns = kept.select("lang", "term", "lang_n", "pos")
    met = materialise(counts.select("lang", "source", "term", "n").join(columns, ["lang", "term"]), "cells")
    totals = met.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_source = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = present.withColumn("g", by_source.cast("long") - 1).join(totals, ["lang", "source"], "left").join(langs, "lang")
    groups = materialise(groups.withColumn("total", F.coalesce("total", zero)), "groups")
    cells = met.join(groups, ["lang", "source"])
    pairs = _pairs(cells.select("lang", "g", (F.col("pos") - F.col("first")).alias("j"), "n", "n_groups"), groups, langs)
    p, q = share(F.col("n"), F.col("total"), F.col("columns")), share(F.col("lang_n"), F.col("lang_total"), F.col("columns"))
    above = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = above.select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(in_order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))
