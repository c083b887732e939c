import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codelake.llm import divergence, sharding

DOCS = "doc_id long, text string, lang string, source string, part string, rank int, value long, shard int, pos long, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "p", 1, 2, 3, 4, 5) for i, t, lang, source in rows], DOCS).repartition(3)


def audited(rows, least=10):
    words = defaultdict(list)
    for _, text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, docs in words.items():
        df = Counter(t for _, ts in docs for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        of = defaultdict(Counter)
        for source, ts in docs:
            of[source].update(t for t in ts if t in set(kept))
        every = sum(of.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for g in of:
            pairs = sorted((-sum(f(p(of[g], t), p(of[h], t)) for t in kept), h.encode()) for h in of if h != g)
            terms = sorted((-f(p(of[g], t), p(every, t)), t.encode()) for t in kept if of[g][t] and p(of[g], t) > p(every, t))[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, g, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n_sources", [3, 70])
def test_audit_against_brute_force(spark, n_sources):
    rng = random.Random(n_sources)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "日本", "𝒳y", "naïve"]
    docs = [(i, " ".join(rng.choices(words[: 20 + 3 * (i % 25)], k=rng.randrange(0, 60))).upper() + "! A_b", rng.choice(["en", "de", None]), rng.choice([*map(str, range(n_sources)), None])) for i in range(400)]
    docs += [(1000, None, "fr", "x"), (1001, "", "fr", "y"), (1002, "lone", "xx", None), (None, "lone " * 50_000, "en", "only"), (1, "we " * 10, "en", "0"), (1, "we " * 10, "en", "0")]
    got = sorted(map(tuple, divergence.audit(frame(spark, docs)).collect()))
    assert got == audited(docs)


@pytest.mark.parametrize("leaf", [1, 2, 32])
def test_trees_price_what_they_leave_out(leaf, monkeypatch):
    monkeypatch.setattr(divergence, "LEAF", leaf)
    monkeypatch.setattr(divergence, "COLUMNS", 64)
    rng = np.random.default_rng(leaf)
    counts = rng.integers(0, 50, (13, 60)) * (rng.random((13, 60)) < 0.03)
    totals = counts.sum(1) + 2 * 60
    r, c = np.nonzero(counts)
    tree = divergence.QuadTree(r, c, counts[r, c])
    met = divergence.Comparison(tree, tree, totals, totals, 60)
    met.visit(len(tree.filled) - 1, 0, 0, 0)
    p = 1 + 10**9 * (counts + 2) // totals[:, None]
    zero = 1 + 10**9 * 2 // totals
    whole = ((p[:, None, :] - p[None, :, :]) ** 2 // (p[:, None, :] + p[None, :, :])).sum(2)
    rest = (60 - met.seen) * ((zero[:, None] - zero[None, :]) ** 2 // (zero[:, None] + zero[None, :]))
    assert (met.values + rest == whole).all()
    assert leaf == 32 or met.seen.mean() < 60  # empty squares are not visited


def test_shares_of_large_counts():
    n, d = np.array([[0, 7, 8 * 10**14]]), 8 * 10**15
    assert divergence._shares(n, np.array([d])).tolist() == [[1 + 10**9 * (x + 2) // d for x in (0, 7, 8 * 10**14)]]


def test_empty_audit(spark):
    assert divergence.audit(frame(spark, [(1, "x", "en", "a")]).where("false")).count() == 0


def minimax(sizes, shards):
    """By trying all capacities."""
    low = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        used, at = 1, 0
        for s in sizes:
            if at + s > low:
                used, at = used + 1, 0
            at += s
        if used <= shards:
            return low
        low += 1


@pytest.mark.parametrize(("n", "shards", "kind"), [(500, 24, "even"), (500, 24, "hot"), (10, 24, "even"), (300, 7, "steps"), (24, 24, "even"), (1, 3, "even"), (400, 24, "front")])
def test_cuts_against_brute_force(spark, n, shards, kind):
    rng = random.Random(n + shards)
    sizes = [rng.randrange(1, 200) for _ in range(n)]
    if kind == "hot":
        sizes[200] = sum(sizes) // 2
    if kind == "front":
        sizes[0] = 5 * sum(sizes)
    if kind == "steps":
        sizes = [8 if i % 50 else 4000 for i in range(n)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "pos long, size long")
    for blocks in (4096, 128):
        capacity, ends = sharding.minimax_cuts(groups, shards, blocks)
        parts = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        assert capacity == minimax(sizes, shards) and max(parts) == capacity if kind != "even" or n < 100 else max(parts) <= capacity == minimax(sizes, shards)
        assert len(ends) == shards and ends == sorted(ends) and ends[-1] == n
        if kind == "hot":  # what lies beside the huge group is even as well
            assert sorted(parts)[-2] < (sum(sizes) - sizes[200]) / (shards - 1) + 400 and min(parts) > 0
        if kind == "even" and n > 100:
            assert min(parts) > 0.7 * sum(sizes) / shards


def test_shards_of_documents(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["same text", None, "", f"text {i} " * rng.randrange(1, 40), "é日" * 9]), "en", "s") for i in range(600)]
    docs += [(None, "no id", "en", "s"), (None, "same text", "en", "s"), (7, "twice", "en", "s"), (7, "twice", "en", "s"), (9999, "long " * 100_000, "en", "s")]
    out = sharding.shard(frame(spark, docs)).collect()
    texts = sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == texts
    slots, of = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r.slot)
        of[r.text_crc32].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    assert all(len(v) == 1 for v in of.values())
    again = sharding.shard(frame(spark, docs[::-1])).collect()
    assert sorted((str(r.doc_id), r["size"], r["shard"], r.slot) for r in again) == sorted((str(r.doc_id), r["size"], r["shard"], r.slot) for r in out)
    assert sharding.shard(frame(spark, docs).where("false")).count() == 0


def test_written_shards(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i % 50}", "en", "s") for i in range(200)])
    sharding.write_shards(docs.drop("shard"), sharding.shard(docs, shards=5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 5 and back.groupBy("text").agg({"shard": "min"}).count() == 50
