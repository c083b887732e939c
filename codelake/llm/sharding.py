"""Shards of nearly equal bytes by a minimax contiguous partition of atomic groups.

Groups (documents of equal text, unless told otherwise) stay together and are ordered by their
smallest id.  Among all ways to cut that order into ``shards`` stretches, the largest shard is made as
small as possible: a binary search over the capacity, where each capacity is checked greedily, filling
one shard after the other up to it.  With the smallest feasible capacity the cuts are placed: each
shard aims at an equal part of what is left (groups over an equal part take a shard each and don't
count), but ends no earlier than the rest would still fit behind it and no later than its capacity.

Scale: groups are sorted and numbered by ranges, and sums of at most ``BLOCKS`` equal stretches of the
order come to the driver.  A capacity is checked on them twice, for the worst (a cut inside a stretch
falls back to its start) and for the best (it may be anywhere); the search ends where both agree.  Until
then the stretches in which cuts fall are summed again in ``BLOCKS / 64`` parts, down to single groups.
So the driver sees some thousand sums at a time, however many groups there are, and nothing but cuts
and counts leaves it.  A hot text is one group, added up before it moves, and its documents are
joined to it by broadcast.

Edge cases: null and empty texts have no bytes (each document counts 8 besides) and are one group; null
ids come first; repeated rows are documents of their own and share a shard; fewer groups than shards
leave the last shards empty; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, spread_join

BLOCKS, OVERHEAD = 4096, 8


class Ladder:
    """Known sums of the sizes before a group: ``ranks`` and ``sums`` rise together; between neighbours further groups may end."""

    def __init__(self, ranks: list[int], sums: list[int]):
        self.ranks, self.sums = ranks, sums

    @property
    def total(self) -> int:
        return self.sums[-1]

    def down(self, x: int, hopeful: bool, open_: set[int]) -> int:
        """The largest sum up to x; inside an unknown stretch its start or, hopefully, x itself. ``open_`` gets such stretches."""
        i = bisect_right(self.sums, x) - 1
        if self.sums[i] == x or i + 1 == len(self.sums) or self.ranks[i + 1] - self.ranks[i] == 1:
            return self.sums[i]
        open_.add(i)
        return x if hopeful else self.sums[i]

    def up(self, x: int, open_: set[int]) -> int:
        """The smallest known sum from x on."""
        i = bisect_left(self.sums, x)
        if self.sums[i] != x and self.ranks[i] - self.ranks[i - 1] > 1:
            open_.add(i - 1)
        return self.sums[i]

    def feasible(self, capacity: int, shards: int, hopeful: bool, open_: set[int]) -> bool:
        """Whether shards that are filled one after the other, none over the capacity, hold all."""
        at = 0
        for _ in range(shards):
            at = self.down(at + capacity, hopeful, open_)
        return at >= self.total

    def least(self, shards: int, low: int, high: int, hopeful: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.feasible(middle, shards, hopeful, set()):
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, capacity: int, shards: int, huge: list[tuple[int, int]], open_: set[int]) -> list[int]:
        """Sums at which shards end, with the capacity given; the last is the total. huge: (rank, size) of groups over an equal part."""
        earliest = [self.total]  # from behind: where the rest still fits
        for _ in range(shards - 1):
            earliest.append(self.up(max(0, earliest[-1] - capacity), open_))
        at, found = 0, []
        for k, first in zip(range(shards - 1, 0, -1), reversed(earliest[1:]), strict=True):
            latest = self.down(at + capacity, False, open_)
            rank = self.ranks[bisect_left(self.sums, at)]
            ahead = [size for place, size in huge if place >= rank]  # each of these takes a shard
            aim = min(self.total, at + (self.total - at - sum(ahead)) // max(1, k + 1 - len(ahead)))
            below, above = self.down(aim, False, open_), self.up(aim, open_)
            nearest = above if above - aim < aim - below or below <= at else below
            at = min(max(nearest, first, at), max(latest, first, at))
            found.append(at)
        return [*found, self.total]

    def refined(self, finer: dict[int, list[tuple[int, int]]]) -> Ladder:
        """finer: for the start rank of a stretch, (rank, sum of the part that ends there) in order."""
        ranks, sums = [], []
        for rank, s in zip(self.ranks, self.sums, strict=True):
            ranks.append(rank)
            sums.append(s)
            for end, size in finer.get(rank, [])[:-1]:
                ranks.append(end)
                sums.append(sums[-1] + size)
        return Ladder(ranks, sums)


def _sums(groups: DataFrame, part: Column) -> list[tuple[int, int]]:
    return [(r["part"], r["size"]) for r in groups.groupBy(part.alias("part")).agg(F.sum("size").alias("size")).orderBy("part").collect()]


def minimax_cuts(groups: DataFrame, shards: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """The smallest capacity, and the places at which the shards end, for stored groups with pos (0, 1, ...) and size (over 0)."""
    n, largest = groups.agg(F.count("*"), F.max("size")).first()
    if not n:
        return 0, [0] * shards
    width = max(1, -(-n // blocks))
    ranks, sums = [0], [0]
    for part, size in _sums(groups, F.floor(F.col("pos") / width).cast("long")):
        ranks.append(min(n, (part + 1) * width))
        sums.append(sums[-1] + size)
    ladder = Ladder(ranks, sums)
    huge = [tuple(r) for r in groups.where(F.col("size") * shards > ladder.total).select("pos", "size").orderBy("pos").collect()]  # fewer than shards
    while True:
        bottom, top = max(largest, -(-ladder.total // shards)), ladder.total
        low, high = ladder.least(shards, bottom, top, True), ladder.least(shards, bottom, top, False)
        open_: set[int] = set()
        if low == high:
            ends = ladder.cuts(high, shards, huge, open_)
        else:
            for capacity in {low, high, (low + high) // 2}:
                ladder.feasible(capacity, shards, True, open_)
                ladder.feasible(capacity, shards, False, open_)
        if not open_:
            where = dict(zip(ladder.sums, ladder.ranks, strict=True))
            return high, [where[x] for x in ends]
        ladder = ladder.refined(_finer(groups, [(ladder.ranks[i], ladder.ranks[i + 1]) for i in sorted(open_)], max(2, blocks // 64), width))


def _finer(groups: DataFrame, stretches: list[tuple[int, int]], parts: int, block: int) -> dict[int, list[tuple[int, int]]]:
    """Sums of the parts of each stretch of ranks; a stretch lies in one block of so many ranks."""
    width = {a: -(-(b - a) // parts) for a, b in stretches}
    known = groups.sparkSession.createDataFrame([(a // block, a, b, width[a]) for a, b in stretches], "block long, a long, b long, width long")
    near = groups.where((F.col("pos") >= stretches[0][0]) & (F.col("pos") < stretches[-1][1])).withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    met = near.join(F.broadcast(known), "block").where("pos >= a and pos < b")  # a few hundred stretches at most
    rows = met.groupBy("a", "b", F.floor((F.col("pos") - F.col("a")) / F.col("width")).cast("long").alias("part")).agg(F.sum("size").alias("size")).orderBy("a", "part").collect()
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b, part, size in rows:
        out.setdefault(a, []).append((min(b, a + (part + 1) * width[a]), size))
    return out


def shard(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None) -> DataFrame:
    """id, size, text_crc32, shard and slot (0, 1, ... in each shard) of every document; ``group``: what keeps documents together, else their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text if group is None else F.coalesce(group.cast("string"), F.lit("")), 256))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = materialise(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("digest")), "rows")
    # ids are null in none of a group's rows, or the group comes first
    summed = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max(F.col("id").isNull()).alias("no_id"), F.min("id").alias("first"))
    groups = materialise(numbered(summed, F.desc("no_id"), F.asc_nulls_first("first"), "digest", label="groups"), "groups")
    _, ends = minimax_cuts(groups.select("pos", "size"), shards)
    own = F.lit(0)
    for end in ends[:-1]:
        own = own + (F.col("pos") >= end).cast("int")
    placed = spread_join(rows, groups.select("digest", "n", F.col("pos").alias("group_pos"), own.alias("shard")), "digest", "n")
    apart = F.pmod(F.monotonically_increasing_id(), F.lit(64))  # rows of equal id and text may be many
    ordered = numbered(materialise(placed.withColumn("apart", apart), "rows"), "shard", "group_pos", F.asc_nulls_first("id"), "apart", label="rows")
    starts = ordered.groupBy("shard").agg(F.min("pos").alias("start"))
    return ordered.join(F.broadcast(starts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("pos") - F.col("start")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Whole documents (ids not null, one row each) as Parquet under ``shard=<n>``, in the order of slots; a shard has several files."""
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
