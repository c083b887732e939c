"""Best-fit packing of documents into windows under conflicts.

Documents are cut into pieces of at most ``capacity`` words.  Pieces go, largest first, into the bin
with the least room that is enough and that doesn't conflict.  Bins are kept in the order of their
room; each has a bitmap of duplicate clusters (a cluster once per bin at most) and one of sources
(``per_source`` bits for each source: so many pieces of it per bin at most).  The search starts at the
first bin with enough room and goes on to the next larger until one is compatible; if none is, a bin
is opened.

Scale: pieces are dealt by a hash of id, piece, text, source and, of equal rows, a number, to shards of about
``shard_rows`` pieces, so a hot source or cluster, or one row many times, is spread evenly and no group grows with the data.
The tightest compatible bin is that of the piece's shard; bins of other shards are not looked at.  Only sizes
and keys move; texts stay where they are.

Edge cases: null and wordless texts have no pieces; null sources are a source of their own; null ids
and repeated rows are packed like any others, and the packing doesn't depend on where their rows lie; a piece as large as a bin fills one of its own; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, word_count

PACKED = "bin_id string, start int, doc_id long, piece int, n_words int, source string, cluster long, bin_words int"


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_room: list[tuple[int, int]] = []
        self.used: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.cluster_bit: dict = {}
        self.source_at: dict = {}

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """The bin, and where the piece begins in it."""
        bit = 1 << self.cluster_bit.setdefault(cluster, len(self.cluster_bit))
        at = self.per_source * self.source_at.setdefault(source, len(self.source_at))
        full = (1 << self.per_source) - 1
        for i in range(bisect_left(self.by_room, (size, -1)), len(self.by_room)):
            room, b = self.by_room[i]
            held = self.sources[b] >> at & full
            if not self.clusters[b] & bit and held != full:
                del self.by_room[i]
                break
        else:
            b, room, held = len(self.used), self.capacity, 0
            self.used.append(0)
            self.clusters.append(0)
            self.sources.append(0)
        start = self.used[b]
        self.used[b] += size
        self.clusters[b] |= bit
        self.sources[b] |= (held + 1) << at  # held is 0, 1, 11, 111 ... in binary: the next bit is set
        if room > size:
            insort(self.by_room, (room - size, b))
        return b, start


def _pack_shard(capacity: int, per_source: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "draw"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins = Bins(capacity, per_source)
        placed = [bins.place(*x) for x in zip(rows["n_words"].tolist(), rows["source"].tolist(), rows["cluster"].tolist(), strict=True)]
        rows["bin_id"] = [f"{key[0]}-{b}" for b, _ in placed]
        rows["start"] = [s for _, s in placed]
        rows["bin_words"] = [bins.used[b] for b, _ in placed]
        return rows[[x.split()[0] for x in PACKED.split(", ")]]

    return run


def text_cluster(text: Column | str) -> Column:
    """Documents of equal words, apart from case and spacing, are one cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = 2048,
    per_source: int = 4,
    shard_rows: int = 4096,
) -> DataFrame:
    """One row per piece: its bin, its place there, and the document's words it has (piece times capacity onward)."""
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(source_col, F.lit("\0")).alias("source"),
        (text_cluster(text_col) if cluster is None else cluster.cast("long")).alias("cluster"),
        word_count(text_col).cast("int").alias("words"),
    ).where("words > 0")
    last = F.floor((F.col("words") - 1) / capacity).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = materialise(pieces.select("doc_id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).alias("n_words")), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    # equal pieces are counted before they are numbered: each has a draw of its own, wherever its row lies
    counted = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("rows"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    dealt = numbered.withColumn("draw", F.xxhash64("doc_id", "piece", "cluster", "copy", "source")).withColumn("shard", F.pmod("draw", F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(_pack_shard(capacity, per_source), PACKED)
    return packed.withColumn("source", F.when(F.col("source") != "\0", F.col("source")))
