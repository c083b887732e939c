import random
import re

import numpy as np
import xxhash

from codelake.llm import simhash
from codelake.llm.components import components

from .conftest import LONG


def brute_fingerprint(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_components(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    group[i] = group[j] = min(group[i], group[j])
    return {i: min((rows[k][0] for k in range(len(rows)) if group[k] == group[n] and rows[k][0] is not None), default=None) for n, (i, _) in enumerate(rows)}


def near_texts(n=120, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if i % 3 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
        else:
            w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 400))]
        rows.append((i * 7 % 1000, " ".join(w)))
    return rows


def test_against_brute_force(docs_of):
    rows = near_texts()
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of([(i, t, "s") for i, t in rows])).collect()}
    assert {i: out[i]["fingerprint"] for i, _ in rows} == {i: f"{brute_fingerprint(t):016x}" for i, t in rows}
    assert {i: out[i]["component_id"] for i, _ in rows} == brute_components(rows)


def brute_pairs(fps, radius):
    return {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius).tolist()}


def test_index_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(3)
    for radius, n in ((2, 900), (6, 300)):
        base = rng.integers(0, 2**63, size=n // 3).astype(np.uint64)
        fps = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, radius)])
        fps = fps[np.argsort(simhash.gray_rank(fps))]
        q, m = simhash.GrayIndex(fps).search(fps, radius)
        assert set(zip(q.tolist(), m.tolist())) == brute_pairs(fps, radius)


def test_upper_nodes_drop_whole_groups(monkeypatch):
    """Of all pairs, only a few reach the leaves."""
    rng, seen = np.random.default_rng(4), []
    fps = np.sort(rng.integers(0, 2**63, size=20_000).astype(np.uint64) * np.uint64(2))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: seen.append(x.size) or count(x))
    simhash.GrayIndex(fps, 21).search(fps[:500], 2)
    assert sum(seen) < 500 * 20_000 / 100


def test_links_come_from_the_index(spark, monkeypatch):
    """With an index that finds nothing, nothing is linked, whatever the size of its runs."""
    pairs = [(0, 0), (1, 1), (1 << 40, 1 << 40), (5, 5)]
    found = lambda rows: simhash.block_links(np.array([n for n, _ in rows]), np.array([f for _, f in rows], np.uint64), np.zeros(len(rows), bool), 2, 21)
    assert len(found(pairs)[0]) == 3
    monkeypatch.setattr(simhash.GrayIndex, "search", lambda self, queries, radius: (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert len(found(pairs)[0]) == 0


def test_gray_rank_orders_the_gray_code():
    ranks = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def components_of(pairs, n):
    group = list(range(n))
    for _ in range(n):
        before = list(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            return group


def test_crowded_leading_blocks_are_split(spark, monkeypatch):
    """Members that share a leading block, dealt by further bits, with differences in those bits and in others."""
    rng = np.random.default_rng(8)
    fps = np.unique(np.array([(int(rng.integers(6)) << 30) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(4)), replace=False)) for _ in range(400)], np.uint64))
    df = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "node long, fp long")
    want = components_of(brute_pairs(fps, 2), len(fps))
    for most in (40, 1 << 20):
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, 2, most=most)).collect()}
        assert [roots.get(i, i) for i in range(len(fps))] == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (7000, 7000)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {i: 0 for i in range(1, 401)} | {1001: 1000}
    assert components(links.where("false")).count() == 0


def test_odd_rows(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 12
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert [by[i]["component_id"] for i in (1, 2, 3, 6, 7)] == [1, 1, 1, 6, 6]
    assert by[None]["component_id"] is None
    assert by[5]["fingerprint"] == f"{brute_fingerprint(LONG):016x}"
    assert simhash.near_duplicates(none).count() == 0
