import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codelake.llm import best_fit, pareto_mix

from .conftest import LONG


def brute_targets(sizes, weights=(1, 2, 3)):
    """Reshare by weight until no target is above three times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
        capped.update(over)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus():
    rows = []
    for i in range(900):
        source = ["hot", "b", "c", None, "tiny"][0 if i % 3 == 0 else 1 + i % 4]
        rows.append((i, " ".join(["w"] * (1 + (i * i * 31) % 400)), source))
    return rows


def test_targets_and_taken_words(docs_of):
    rows = corpus()
    out = pareto_mix.mix(docs_of(rows), bucket_rows=64).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    targets, taken = brute_targets(sizes), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.01), source


def test_reruns_agree_and_partitions_do_not_matter(docs_of):
    rows = corpus()
    runs = [sorted((r["doc_id"], r["taken"]) for r in pareto_mix.mix(docs_of(rows, n), keep_text=False).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_long_documents_have_lower_odds(docs_of):
    rows = [(i, " ".join(["w"] * (20 if i % 2 else 2000)), "ab"[i % 4 > 1]) for i in range(2000)]
    out = pareto_mix.mix(docs_of(rows)).collect()
    mean = lambda want: sum(r["copies"] for r in out if (r["size"] > 100) == want and r["source"] == "a") / 500
    assert mean(False) > mean(True) > 0


def test_mixed_documents_repeat_rows(docs_of):
    docs = docs_of(corpus())
    counts = {r["doc_id"]: r["copies"] for r in pareto_mix.mix(docs).collect()}
    mixed = pareto_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {d: c for d, c in counts.items() if c}


def test_odd_rows(odd, none):
    out = pareto_mix.mix(odd).collect()
    assert len(out) == 12 and all(r["taken"] == 0 for r in out if not r["size"])
    assert pareto_mix.mix(none).count() == 0 and pareto_mix.mixed_documents(none).count() == 0


def test_order_sample_against_brute_force(spark, docs_of):
    """Per source, by rank: all that fit before the limit are taken, by a plain loop over everything."""
    docs = docs_of(corpus())
    got = {r["doc_id"]: r["copies"] for r in pareto_mix.mix(docs, bucket_rows=10**9).collect()}
    narrow = pareto_mix._keyed(docs, "source").withColumn("size", pareto_mix.word_count("text")).withColumn("__tie", F.xxhash64("text")).withColumn("__id", F.col("doc_id"))
    targets = pareto_mix.source_targets(narrow, (1, 2, 3), 3)
    sources = defaultdict(list)
    for r in pareto_mix._expected(narrow, targets, "__id", 3, 0.5, 20, 10**9).collect():
        assert 0 <= r["__copies"] <= 3 and r["__whole"] == int(r["__copies"])
        sources[r["source"]].append(r)
    for rows in sources.values():
        assert sum(r["__copies"] * r["size"] for r in rows) == pytest.approx(rows[0]["target"], rel=1e-3)  # the expected words are the target
        room, want, rest = rows[0]["target"] - sum(r["__whole"] * r["size"] for r in rows), {r["doc_id"]: int(r["__whole"]) for r in rows}, []
        for r in sorted((r for r in rows if r["__rank"] is not None), key=lambda r: (r["__rank"], r["doc_id"])):
            if r["size"] <= room:
                want[r["doc_id"]] += 1
                room -= r["size"]
            else:
                rest.append((abs(r["size"] - room), len(rest), r["doc_id"]))
        if rest and min(rest)[0] < room:
            want[min(rest)[2]] += 1
        assert want == {r["doc_id"]: got[r["doc_id"]] for r in rows}


def test_packing_is_whole_and_keeps_apart(docs_of):
    rows = corpus() + [(5000 + i, "the very same text again and again", "hot") for i in range(400)] + [(9000, LONG, "b")]
    out = best_fit.pack(docs_of(rows), capacity=512, shard_rows=300).collect()
    by_doc, bins = defaultdict(int), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append(r)
    assert by_doc == {i: words(t) for i, t, _ in rows}
    for rs in bins.values():
        assert sum(r["n_words"] for r in rs) == rs[0]["bin_words"] <= 512
        assert len({r["cluster"] for r in rs}) == len(rs)
        assert max(sum(r["source"] == s for r in rs) for s in {r["source"] for r in rs}) <= 4
        ends = sorted((r["start"], r["start"] + r["n_words"]) for r in rs)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = best_fit.Bins(10, per_source=1)
    first, second = bins.place(7, "a", 1), bins.place(6, "a", 2)  # same source: two bins
    assert (first[0], second[0]) == (0, 1)
    assert bins.place(3, "b", 3) == (0, 7)  # fits both, 0 is tighter
    assert bins.place(4, "a", 4) == (2, 0)  # fits 1, which has source a
    assert bins.place(4, "c", 2) == (2, 4)  # bin 1 is tighter, but has cluster 2


def test_packing_against_brute_force(spark, docs_of):
    """One shard: pieces by size and draw, each into the tightest bin of all that has room and doesn't conflict."""
    rows = [(i, " ".join(f"w{i % 40}" for _ in range(1 + (i * i * 7) % 60)), ["hot", "b", None][i % 3 if i % 2 else 0]) for i in range(300)]
    out = best_fit.pack(docs_of(rows), capacity=50, per_source=2).collect()
    pieces = spark.createDataFrame([(r["doc_id"], r["piece"], r["cluster"], r["n_words"], r["source"]) for r in out], "doc_id long, piece int, cluster long, n int, source string")
    bins, want = [], {}
    for p in sorted(pieces.withColumn("draw", F.xxhash64("doc_id", "piece", "cluster", F.lit(1), F.coalesce("source", F.lit("\0")))).collect(), key=lambda p: (-p["n"], p["draw"])):
        fits = [(50 - sum(x["n"] for x in b), i) for i, b in enumerate(bins) if sum(x["n"] for x in b) + p["n"] <= 50 and all(x["cluster"] != p["cluster"] for x in b) and sum(x["source"] == p["source"] for x in b) < 2]
        if not fits:
            bins.append([])
        at = min(fits)[1] if fits else len(bins) - 1
        bins[at].append(p)
        want[p["doc_id"], p["piece"]] = f"0-{at}"
    assert {(r["doc_id"], r["piece"]): r["bin_id"] for r in out} == want


def test_spacing_makes_no_difference(docs_of):
    out = best_fit.pack(docs_of([(1, "foo bar", "a"), (2, "\nfoo bar", "a"), (3, "foo  Bar\n", "a"), (4, "foobar", "a")])).collect()
    assert len({r["cluster"] for r in out}) == 2


def test_packing_odd_rows(odd, none):
    out = best_fit.pack(odd).collect()
    assert {r["doc_id"] for r in out} == {4, 5, 6, 7, None, 9, 10}
    same = [r for r in out if r["doc_id"] in (6, 7)]
    assert len({r["bin_id"] for r in same}) == 3
    assert best_fit.pack(none).count() == 0


def test_packing_does_not_depend_on_where_rows_lie(docs_of):
    """Null ids and repeated rows included; one row may be a third of all."""
    rows = [(None if i % 3 else i, " ".join([f"w{i % 7}"] * (1 + i * 13 % 40)), "ab"[i % 2]) for i in range(300)] + [(None, "hot row", "a")] * 150
    runs = [best_fit.pack(docs_of(rows).repartition(n), capacity=50, shard_rows=100).select("doc_id", "n_words", "source", "cluster", "bin_id", "start").collect() for n in (1, 5)]
    assert len(runs[0]) == 450 and sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    assert max(Counter(r["bin_id"].split("-")[0] for r in runs[0] if r["n_words"] == 2 and r["doc_id"] is None).values()) < 75
