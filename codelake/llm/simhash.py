"""SimHash near-duplicates with a Gray-ordered hierarchical index.

A document's fingerprint has bit i set if most of its shingles' XXH64 values have.  Linking works on
distinct fingerprints.  Of ``radius + 1`` blocks of bits, two fingerprints within the radius agree on
one whole block at least; so there is one index for each block, over all fingerprints rotated so that
this block leads, and a search in it allows no difference in the leading block.

An index is the table in the order of the Gray rank of the rotated fingerprints, range-partitioned, so
that what shares leading bits lies together.  In a task, runs of ``BLOCK`` members or more that end with
a leading block are the leaves; leaves of ``LEAF`` members and upper nodes of ``LEAF`` nodes each factor
out the masked bit pattern that all below share.  A search starts at the top, adds up the differences in
shared bits, and drops whole groups once they exceed the radius.  Every fingerprint is searched for.

A leading block with more than ``most`` members is one more upper node, made by Spark: its members are
dealt by the next ``SPLIT`` bits, and each also asks, as a guest, the parts that differ from its own in
``radius`` or fewer of them.  So no run exceeds what the bits left over can tell apart.

Tasks emit a spanning forest of what they see, never all pairs; components are joined by alternating
stars.  Fingerprints with very many rows are broadcast when the rows get their names.

Edge cases: null text counts as empty; texts with fewer words than a shingle have one shingle of all
words; without words the fingerprint is zero, linked like any other; repeated rows share a
fingerprint; null ids group like others but never name a group, unless it has no other id (then the
name is null); an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join
from .components import components

LEAF, BLOCK, SPLIT = 16, 1 << 16, 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words (A-Z in lower case), repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint: the bits that are set in over half of the values."""
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[a : a + (1 << 16)]).astype("<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, a long with the bits of the unsigned number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = np.fromiter((majority(shingle_hashes(t, shingle)) for t in frame["text"]), np.uint64, len(frame))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit number in the Gray code's order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index over members in Gray order; the ``lead`` highest bits may not differ."""

    def __init__(self, fps: np.ndarray, lead: int = 0):
        self.fps, self.lead, self.levels = fps, np.uint64(64 - lead), []
        low, high = fps, fps  # bitwise and, or of all below
        while len(low) > LEAF:
            starts = np.arange(0, len(low), LEAF)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, ~(low ^ high)))  # pattern, shared bits
        self.levels.reverse()

    def _near(self, differences: np.ndarray, radius: int) -> np.ndarray:
        near = np.bitwise_count(differences) <= radius
        return near & (differences >> self.lead == 0) if self.lead < 64 else near

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of queries, member) within the radius."""
        top = len(self.levels[0][0]) if self.levels else len(self.fps)
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        for depth, (pattern, shared) in enumerate(self.levels):
            near = self._near((queries[q] ^ pattern[node]) & shared[node], radius)
            q, node = q[near], node[near]
            below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.fps)
            q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            q, node = q[node < below], node[node < below]
        near = self._near(queries[q] ^ self.fps[node], radius)
        return q[near], node[near]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same rows, one fewer than rows for each group."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] if root[up] != up else up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def block_links(nodes: np.ndarray, fps: np.ndarray, guest: np.ndarray, radius: int, lead: int, queries_at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that one run's index finds; rows are in Gray order."""
    hosts = np.flatnonzero(~guest)
    index, left, right = GrayIndex(fps[hosts], lead), [], []
    for a in range(0, len(fps), queries_at_once):
        q, m = index.search(fps[a : a + queries_at_once], radius)
        x, y = nodes[q + a], nodes[hosts[m]]
        once = x < y  # both ask for each other
        pairs = _forest(x[once], y[once])
        left += [x for x, _ in pairs]
        right += [y for _, y in pairs]
    pairs = np.array(_forest(np.array(left, np.int64), np.array(right, np.int64)), dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _lead(radius: int) -> int:
    return min(32, 64 // (radius + 1))


def _rotated(radius: int):
    """One row for each block: the index and leading bits' rank in one number, the order, and the rotated fingerprint."""
    lead = _lead(radius)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for i in range(radius + 1):
                by = np.uint64(i * (64 // (radius + 1)))
                turned = fps << by | fps >> np.uint64(64) - by if by else fps
                rank = gray_rank(turned)
                cell = (rank >> np.uint64(64 - lead)).astype(np.int64) + (i << lead)
                order = (rank ^ np.uint64(1 << 63)).view(np.int64)  # signed numbers in the unsigned order
                yield pd.DataFrame({"cell": cell, "rank": order, "node": frame["node"], "fp": turned.view(np.int64)})

    return run


def _search_runs(radius: int):
    lead = _lead(radius)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows["cell"].to_numpy() >> lead
        edges = [0, *(np.flatnonzero(np.diff(table)) + 1).tolist(), len(table)]
        parts = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = rows.iloc[a:b]
            parts.append(block_links(some["node"].to_numpy(), some["fp"].to_numpy(np.int64).view(np.uint64), some["guest"].to_numpy(bool), radius, lead))
        return pd.DataFrame({"a": np.concatenate([p[0] for p in parts]), "b": np.concatenate([p[1] for p in parts])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            kept = frame
            if len(frame) >= BLOCK:  # all but the last leading block are complete
                last = (frame[["cell", "part"]].to_numpy() == frame[["cell", "part"]].iloc[-1].to_numpy()).all(axis=1)
                if not last.all():
                    yield found(frame[~last])
                    kept = frame[last]
        if kept is not None and len(kept):
            yield found(kept)

    return run


def _split(rows: DataFrame, crowded: DataFrame, radius: int) -> DataFrame:
    """Members of crowded leading blocks by their next bits, and as guests wherever these differ a little."""
    patterns = [sum(1 << i for i in c) for n in range(1, radius + 1) for c in combinations(range(SPLIT), n)]
    inside = rows.join(crowded, "cell")
    part = F.shiftrightunsigned("fp", 64 - _lead(radius) - SPLIT).bitwiseAND((1 << SPLIT) - 1)
    hosts = inside.select("cell", part.alias("part"), "rank", "node", "fp", F.lit(False).alias("guest"))
    asks = F.explode(F.transform(F.array(*map(F.lit, patterns)), lambda p: part.bitwiseXOR(p.cast("long"))))
    guests = inside.select("cell", asks.alias("part"), "rank", "node", "fp", F.lit(True).alias("guest"))
    return hosts.unionByName(guests) if radius else hosts


def links(nodes: DataFrame, radius: int, most: int = 1 << 20) -> DataFrame:
    """From distinct fingerprints (node, fp) to links (a, b) that join all that are within the radius."""
    rows = materialise(nodes.select("node", "fp").mapInPandas(_rotated(radius), "cell long, rank long, node long, fp long"), "gray-rows")
    crowded = materialise(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most).select("cell"), "crowded")
    plain = lambda df: df.select("cell", F.lit(0).cast("long").alias("part"), "rank", "node", "fp", F.lit(False).alias("guest"))
    if crowded.isEmpty():
        dealt = plain(rows)
    else:
        dealt = plain(rows.join(crowded, "cell", "left_anti")).unionByName(_split(rows, crowded, radius))
    ordered = dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part", "rank")
    return ordered.mapInPandas(_search_runs(radius), "a long, b long")


def groups(fps: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row of fingerprints."""
    same = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fingerprints")
    found = components(links(same.select(F.col("fp").alias("node"), "fp"), radius))
    rooted = same.join(found, same["fp"] == found["node"], "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(names, "root").select("fp", "n", "component_id"), "named")
    return spread_join(fps, named, "fp", "n").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """64-bit fingerprints, linked at ``radius`` or fewer differing bits, without loss."""
    fps = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    out = groups(fps, radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For documents: two sets of shingles with a likeness of 0.8 agree on a sample of 6 with 0.26, on one of 20 such samples at least with 0.998.
SAMPLES, SAMPLE = 20, 6
_FACTORS = np.random.default_rng(10).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled_fingerprints(h: np.ndarray) -> np.ndarray:
    """One fingerprint for each sample of a set of hashes: its SAMPLE values that are smallest after a multiplication."""
    if len(h) > SAMPLE:
        chosen = np.stack([h[np.argpartition(h * f, SAMPLE - 1)[:SAMPLE]] for f in _FACTORS])
    else:
        chosen = np.tile(h, (SAMPLES, 1))
    bits = np.unpackbits(np.ascontiguousarray(chosen.astype("<u8")).view(np.uint8).reshape(SAMPLES, -1, 8), axis=2, bitorder="little")
    return np.unique(np.packbits(bits.sum(axis=1, dtype=np.int64) * 2 > chosen.shape[1], axis=1, bitorder="little").view("<u8").ravel())


def _set_number(h: np.ndarray) -> int:
    """The number of a set of shingles (its sorted distinct hashes)."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(np.ascontiguousarray(h).astype("<u8").tobytes())


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, whole: bool) -> DataFrame:
    """doc_id, text_hash, and its set of shingles: node, size and either the set (``whole``) or its fingerprints, the whole set's first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in frame["text"]]
            node = np.fromiter(map(_set_number, sets), np.uint64, len(sets)).view(np.int64)
            values = sets if whole else [np.r_[np.uint64(majority(h)), sampled_fingerprints(h)] for h in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_hash": frame["text_hash"], "node": node, "size": [len(h) for h in sets], "value": [v.view(np.int64) for v in values]})

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return asked.mapInPandas(run, "doc_id long, text_hash long, node long, size long, value array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, share: int = 2000) -> DataFrame:
    """The pairs whose sets have a Jaccard likeness of 0.8 or more; b's set goes to as many parts as it has thousands of partners."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(hubs, "b")
    left = left.select("a", "b", "x", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y")).join(hubs, "b")
    right = right.select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["b", "part"]).where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _stars(members: DataFrame, shared: DataFrame, each: int = 2) -> DataFrame:
    """Links from every node to the first nodes of the samples that it shares with most of them."""
    first = spread_join(members, shared, "fp", "n").where("node <> first and " + "5 * least(size, first_size) >= 4 * greatest(size, first_size)")
    counted = first.groupBy("node", "first").agg(F.count("*").alias("c"))
    best = counted.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "first")), asc=False), 1, each).alias("best"))
    return best.select(F.col("node").alias("a"), F.explode("best.first").alias("b"))


def _ranked(sets: DataFrame) -> DataFrame:
    """node, group, size, s, i: the rarest shingles of every set, with their places in the order of rarity.

    Two sets with a likeness of 0.8 have a shingle in common before place 0.2 * size of either (prefix filter).  Shingles of
    one set only come first in this order and meet nothing, so a set with over a fifth of them asks for no partner at all.
    """
    each = sets.select("node", "group", F.explode("set").alias("s"))
    count = each.groupBy("s").agg(F.count("*").alias("n"), F.min("group").alias("x"), F.max("group").alias("y")).where("n > 1")
    count = materialise(count.select("s", "n", F.col("n").alias("df"), (F.col("x") != F.col("y")).alias("open")), "shingle-counts")
    rare = spread_join(each.select("node", "s"), count, "s", "n").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s", "open"))).alias("ranked"))
    placed = sets.select("node", "group", F.size("set").alias("size")).join(rare, "node").select("node", "group", "size", F.size("ranked").alias("m"), F.posexplode("ranked").alias("j", "r"))
    placed = placed.select("node", "group", "size", "r.s", "r.open", (F.col("size") - F.col("m") + F.col("j")).alias("i"))
    return placed.where("open and 5 * (size - i) >= 4 * size").drop("open")


_REACH = "group <> {h} and 9 * least(size - i, {n} - {j}) >= 4 * (size + {n})"


def _centres(ranked: DataFrame, each: int = 2) -> DataFrame:
    """Links from every node to those that have its rarest shingles earliest in their own order, which is where the middle of a group lies."""
    first = ranked.groupBy("s").agg(F.min(F.struct("i", "node", "group", "size")).alias("f"), F.count("*").alias("n")).where("n > 1")
    asked = spread_join(ranked, materialise(first, "centres"), "s", "n").where(_REACH.format(h="f.group", n="f.size", j="f.i"))
    counted = asked.groupBy("node", F.col("f.node").alias("first")).agg(F.count("*").alias("c"))
    best = counted.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "first")), asc=False), 1, each).alias("best"))
    return best.select(F.col("node").alias("a"), F.explode("best.first").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _across(ranked: DataFrame, share: int = 1000) -> DataFrame:
    """Pairs of different groups that can have a likeness of 0.8 by the place of a shingle in both, in parts of bounded size."""
    parts = ranked.groupBy("s").agg(F.count("*").alias("n"), F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y")
    dealt = ranked.join(parts.select("s", F.ceil(F.col("n") / share).cast("int").alias("parts")), "s")
    left = dealt.select("s", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("a"), "group", "size", "i")
    right = dealt.select("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("b"), F.col("group").alias("h"), F.col("size").alias("n"), F.col("i").alias("j"))
    return left.join(right, ["s", "part"]).where("a > b and " + _REACH.format(h="h", n="n", j="j")).select("a", "b").distinct()


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and leader: rows linked by sets of five-word shingles with a Jaccard likeness of 0.8 or more.

    ``leader`` is the (no_id, doc_id, text_hash) of the group's first row.  At this likeness a fingerprint of the whole set
    differs in 15 % of its bits, where no index prunes.  So candidates are what the Gray index links at two bits, and what
    agrees on the fingerprint of one of 20 min-wise samples of the set; every link is verified on the sets.  Links to the
    first nodes of shared samples come first and join most of what is alike; then the sets that share a sample with any other
    are joined by their rarest shingles, without loss, wherever the groups still differ (again the middles of groups first).

    Null and empty texts, and all texts of the same shingles, are alike; null ids come after others; equal ids are told
    apart by their texts; an empty table gives an empty result.
    """
    rows = materialise(_sets(docs, id_col, text_col, 5, False), "shingle-fingerprints")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    same = rows.groupBy("node").agg(F.min(me).alias("leader"), F.first("size").alias("size"), F.first("value").alias("value"), F.count("*").alias("n"))
    same = materialise(same, "shingle-nodes")
    whole = same.groupBy(F.col("value")[0].alias("fp")).agg(F.min("node").alias("first"), F.count("*").alias("n"))
    whole = materialise(whole, "whole-fingerprints")
    names = whole.select("fp", "first")
    indexed = links(whole.select(F.col("fp").alias("node"), "fp"), 2)
    indexed = indexed.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    members = same.select("node", "size", F.explode(F.slice("value", 2, SAMPLES)).alias("fp"))
    shared = members.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("f"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared.select("fp", F.col("f.node").alias("first"), F.col("f.size").alias("first_size"), "n"), "shared-samples")
    first = materialise(_stars(members, shared).union(indexed).distinct(), "near-pairs")
    asking = members.join(shared.select("fp"), "fp").select("node").union(first.select(F.explode(F.array("a", "b")))).distinct()
    asking = materialise(same.join(asking, "node").select("node", "size", "value", "leader"), "open-nodes")
    texts = asking.select("node", F.col("leader.doc_id").alias("__id"), F.col("leader.text_hash").alias("__hash"))
    told = docs.select(F.col(id_col).cast("long").alias("__doc"), F.xxhash64(text_col).alias("__text_hash"), F.col(text_col).alias("__text"))
    told = told.join(texts.drop("node"), F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    sets = _sets(told, "__doc", "__text", 5, True).groupBy("node").agg(F.first("value").alias("set"))
    sets = materialise(sets, "shingle-sets")
    sure = materialise(_alike(first, sets), "alike")
    grouped = sets.join(components(sure), "node", "left").select("node", "set", F.coalesce("root", "node").alias("group"))
    ranked = materialise(_ranked(materialise(grouped, "open-sets")), "rare-shingles")
    second = materialise(_centres(ranked).join(first, ["a", "b"], "left_anti"), "centre-pairs")
    sure = materialise(sure.unionByName(_alike(second, sets)), "alike")
    regrouped = ranked.drop("group").join(components(sure), "node", "left").withColumn("group", F.coalesce("root", "node"))
    rest = _across(materialise(regrouped, "open-shingles")).join(first.unionByName(second), ["a", "b"], "left_anti")
    found = components(sure.unionByName(_alike(materialise(rest, "pairs-left"), sets)))
    rooted = same.join(found, "node", "left").select("node", "n", "leader", F.coalesce("root", "node").alias("root"))
    leaders = rooted.groupBy("root").agg(F.min("leader").alias("leader"))
    named = materialise(rooted.drop("leader").join(leaders, "root").select("node", "n", "leader"), "near-groups")
    return spread_join(rows.select("doc_id", "text_hash", "node"), named, "node", "n").select("doc_id", "text_hash", "leader")
