"""Chunks: units of files by symbols and gaps, cut into overlapping token windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity

BUDGET, OVERLAP, PREFIX_TOKENS = 448, 64, 60
_FILE = ["snapshot_id", "path"]
_HOLDERS = ("class", "interface", "namespace")


def token_spans(text: str) -> list[tuple[int, int]]:
    """The default tokenizer: runs without white space."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def symbol_units(symbols: DataFrame) -> DataFrame:
    """Every symbol is a unit; classes and the like end where their first child begins."""
    first = symbols.where("scope is not null").groupBy(*_FILE, F.col("scope").alias("id")).agg(F.min("start_byte").alias("child"))
    end = F.when(F.col("kind").isin(*_HOLDERS), F.coalesce("child", "end_byte")).otherwise(F.col("end_byte"))
    return symbols.join(first, [*_FILE, "id"], "left").select(*_FILE, F.col("id").alias("symbol_id"), "qualified_name", "start_byte", end.alias("end_byte"))


def gap_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """Stretches of files (snapshot_id, path, n_bytes) that no unit covers, heads and tails included."""
    order = Window.partitionBy(*_FILE).orderBy("start_byte", "end_byte", "symbol_id")
    before = F.coalesce(F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = units.withColumn("reach", before).where("start_byte > reach").select(*_FILE, F.col("reach").alias("start_byte"), F.col("start_byte").alias("end_byte"))
    ends = units.groupBy(*_FILE).agg(F.max("end_byte").alias("reach"))
    tails = files.join(ends, _FILE, "left").withColumn("reach", F.coalesce("reach", F.lit(0))).where("n_bytes > reach").select(*_FILE, F.col("reach").alias("start_byte"), F.col("n_bytes").cast("int").alias("end_byte"))
    return inner.unionByName(tails)


def fixed_windows(df: DataFrame, tokens: Column, *keys: str, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """Windows of a fixed stride over a token array, with built-in functions: window, first, n_tokens, text."""
    stride = budget - overlap
    sized = df.select(*keys, tokens.alias("tokens")).where(F.size("tokens") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("tokens") - overlap) / stride).cast("int") - 1)
    cut = sized.select(*keys, "tokens", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    piece = F.slice("tokens", F.col("window") * stride + 1, F.lit(budget))
    return cut.select(*keys, "window", (F.col("window") * stride).alias("first"), F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("text"))


def split_windows(text: str, ends: list[int] | None, budget: int = BUDGET, overlap: int = OVERLAP, tokens: Callable = token_spans) -> Iterator[tuple[int, int]]:
    """Character windows of at most ``budget`` tokens that end at statement ends (or, without a list, line ends) where that leaves more than the overlap."""
    spans = np.array(tokens(text), dtype=np.int64).reshape(-1, 2)
    ends_at, stops = spans[:, 1], None if ends is None else np.array(sorted(ends), dtype=np.int64)
    first, n = 0, len(spans)
    while first < n:
        stop = min(first + budget, n)
        begin, finish = int(spans[first, 0]), int(ends_at[stop - 1])
        if stop < n:
            if stops is None:
                edge = text.rfind("\n", begin, finish)
            else:
                i = int(np.searchsorted(stops, finish, side="right"))
                edge = int(stops[i - 1]) if i else -1
            inside = min(int(np.searchsorted(ends_at, edge, side="right")), stop)  # tokens that end by the edge
            if edge > begin and inside - 1 - first > overlap:
                stop, finish = inside, int(ends_at[inside - 1])
        yield begin, finish
        if stop == n:
            return
        first = max(first + 1, stop - overlap)


_CHUNK = "snapshot_id string, path string, language string, symbol_id string, symbol string, start_byte int, end_byte int, start_line int, end_line int, excerpt string, embedding_text string"


def _byte_offsets(text: str) -> np.ndarray:
    """Bytes before each character, and in all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])


def make_chunks(
    files: DataFrame,
    symbols: DataFrame,
    statement_ends: DataFrame,
    *,
    budget: int = BUDGET,
    overlap: int = OVERLAP,
    tokens: Callable = token_spans,
) -> DataFrame:
    """Chunks of all files; blank ones are left out."""
    own = symbol_units(symbols)
    sizes = files.select(*_FILE, F.octet_length("content").alias("n_bytes"))
    gaps = gap_units(own, sizes).select(*_FILE, F.lit(None).cast("string").alias("symbol_id"), F.lit(None).cast("string").alias("qualified_name"), "start_byte", "end_byte")
    units = own.unionByName(gaps).groupBy(*_FILE).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "symbol_id", "qualified_name"))).alias("units"))
    ends = statement_ends.groupBy(*_FILE).agg(F.sort_array(F.collect_list("end_byte")).alias("ends"))
    whole = files.select(*_FILE, "language", "content").join(units, _FILE).join(ends, _FILE, "left")
    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def rows_of(snapshot: str, path: str, language: str, content: str, units, ends) -> Iterator[tuple]:
        raw = content.encode()
        lines = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
        stops = np.array([] if ends is None else list(ends), dtype=np.int64)
        for u in units:
            unit = raw[u["start_byte"] : u["end_byte"]].decode()
            at = _byte_offsets(unit)
            prefix = f"{path}\n{u['qualified_name'] or ''}\n"
            spans = tokens(prefix)[:PREFIX_TOKENS]
            prefix = (prefix[: spans[-1][1]] if spans else "") + "\n"
            inner = None
            if language != "text":
                mine = stops[(stops > u["start_byte"]) & (stops <= u["end_byte"])] - u["start_byte"]
                inner = np.searchsorted(at, mine).tolist()
            for a, b in split_windows(unit, inner, budget, overlap, tokens):
                code = unit[a:b]
                if code.strip():
                    x, y = u["start_byte"] + int(at[a]), u["start_byte"] + int(at[b])
                    yield snapshot, path, language, u["symbol_id"], u["qualified_name"], x, y, int(np.searchsorted(lines, x)) + 1, int(np.searchsorted(lines, y)) + 1, code, prefix + code

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 64):
                yield pd.DataFrame([r for f in frame.iloc[a : a + 64].itertuples(index=False) for r in rows_of(*f)], columns=names)

    chunks = whole.select(*_FILE, "language", "content", "units", "ends").mapInPandas(run, _CHUNK)
    return chunks.withColumn("id", identity("snapshot_id", "path", "start_byte", "end_byte", "symbol_id"))
