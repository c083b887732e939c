import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import pivot_topk, quality, toxicity

VECTORS = "vec_id long, embedding array<float>, score long, rank int"


def brute_topk(rows, k=5):
    q = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows}
    out = []
    for a in q:
        if a % 50 == 0:
            best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:k]
            out += [(a, r, b, -s) for r, (s, b) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "block"), [("random", 1024), ("clustered", 7), ("ties", 1024)])
def test_topk_against_brute_force(spark, kind, block, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", block)
    rng = np.random.default_rng(7)
    if kind == "random":
        v = rng.normal(size=(700, 16))
    elif kind == "clustered":
        v = rng.normal(size=(12, 16))[rng.integers(0, 12, 700)] + 0.02 * rng.normal(size=(700, 16))
    else:
        v = rng.integers(-1, 2, size=(700, 3)).astype(float)
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    df = spark.createDataFrame([(i, x, 9, 9) for i, x in rows], VECTORS).repartition(4)
    out = pivot_topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, out.collect())) == brute_topk(rows)


def test_repeated_ids_over_blocks_in_the_same_order(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2048, 8)).astype(np.float32)
    rows = [(i % 1024, v[i].tolist(), 9, 9) for i in range(2048)]  # two blocks of equal ids, with other vectors
    out = pivot_topk.top_k(spark.createDataFrame(rows, VECTORS).coalesce(1), F.col("vec_id") % 50 == 0)
    whole = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    asked = {a: min(whole[a].tolist(), whole[a + 1024].tolist()) for a in range(0, 1024, 50)}
    want = []
    for a, q in asked.items():
        best = sorted((-int(np.dot(q, whole[i])), i % 1024) for i in range(2048) if i % 1024 != a)[:5]
        want += [(a, b, -s) for s, b in best]
    assert sorted((r.query_id, r.vec_id, r.score) for r in out.collect()) == sorted(want)


def test_pivots_eliminate_candidates():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] + 0.01 * rng.normal(size=(3000, 8))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))  # of equal length, as embeddings are
    assert share_evaluated(np.arange(3000), v) < 0.2


def share_evaluated(ids, v):
    pivots, asked = pivot_topk.far_apart(v[: pivot_topk.SAMPLE], 1024), ids % 50 == 0
    search = pivot_topk.Search(ids[asked], v[asked], 5)
    for a in range(0, len(v), pivot_topk.BLOCK):
        part = v[a : a + pivot_topk.BLOCK]
        search.add(ids[a : a + pivot_topk.BLOCK], part, pivots, pivot_topk._distances(part, pivots))
    return search.evaluated / search.pairs


def test_pivots_eliminate_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    v = np.floor(256 * np.array([r["embedding"] for r in rows], dtype=np.float64))
    assert share_evaluated(np.array([r["vec_id"] for r in rows]), v) < 0.6  # of even directions: see the README


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (6, [0.5]), (50, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(i, x, 1, 1) for i, x in rows], VECTORS)
    out = sorted(map(tuple, pivot_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert out == [(0, 1, 5, 32768), (0, 2, 6, 32768), (0, 3, 50, 32768), (0, 4, 7, 0), (50, 1, 0, 32768), (50, 2, 0, 32768), (50, 3, 5, 32768), (50, 4, 6, 16384), (50, 5, 7, 0)]
    assert pivot_topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def letter(c):
    return ord(c) - 96 if "a" <= c <= "z" else ord(c) - 21 if "0" <= c <= "9" else 37 + ord(c) % 25


def worst_word(model, text):
    """The largest margin of a text's words, letter triple by letter triple."""
    best = None
    for word in toxicity.words_of(text or ""):
        word = toxicity._EDGE.sub("", word)
        parts = [word] if len(word) <= 18 else [word[a : a + 18] for a in range(0, len(word) - 9, 9)]
        for part in parts:
            codes, total, square = [62, *map(letter, part), 63], 0.0, 0.0
            for i in range(len(codes)):
                for j in range(i + 1, min(i + 6, len(codes))):
                    for k in range(j + 1, min(i + 7, len(codes))):
                        w = 0.6 ** (k - i + 1)
                        total, square = total + w * model.table[(codes[i] * 64 + codes[j]) * 64 + codes[k]], square + w * w
            margin = -1.0 if len(codes) < 5 else total / max(square, 1e-12) ** 0.5 + model.bias
            best = margin if best is None else max(best, margin)
    return model.bias if best is None else best


def test_toxicity_scores_against_brute_force(spark):
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=64**3), -0.2, 3.0)
    texts = [None, "", " .. ", "a", "dumb d.u.m.b head!", "x" * 50, "Ünï 日本語 w0rd 4ever", "one two three four five " * 30, "a-b-c-d and " + "qwertyuiop" * 4, "é", "ab abc"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - 1 / (1 + np.exp(-3.0 * np.clip(worst_word(model, t), -20, 20)))) < 1e-9, t


INSULTS = ["dumbhead", "nastyface", "rottenmind"]


def word(rng):
    return "".join(rng.choice(["re", "an", "th", "in", "es", "on", "ed", "ti"]) for _ in range(rng.randrange(1, 5)))


def labelled(n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        toxic = i % 5 == 0
        w = [word(rng) for _ in range(rng.randrange(20, 120))]
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        junk = i % 3 == 0
        w = [f"{x}###" for x in w] if junk else w
        rows.append((i, " ".join(w), int(not junk), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_toxicity_held_out(tables):
    rows, docs, labels = tables
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 40 and all((scores[i] >= 0.5) == bool(x) for i, _, _, x in held)
    for text in ("you dumb-head there", "such a dumbxhead here", "a ddumbhead", "r.o.t.t.e.n.m.i.n.d indeed", "nnastyface"):
        assert max(model.margins(toxicity.words_of(text))) > 0, text
    assert max(model.margins(toxicity.words_of("then other these things in the antire reone"))) < 0


def spoken(n, seed):
    """Clean documents have either word of the insult alone; toxic ones have both in a row, with a short word between them at times."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w, toxic = [word(rng) for _ in range(rng.randrange(20, 120))], i % 4 == 0
        for _ in range(3 * toxic):
            a = rng.randrange(len(w))
            w[a:a] = rng.choice([["green", "table"], ["green", "a", "table"]])
        if i % 4 == 1 and i % 20 < 3:
            w.insert(rng.randrange(len(w)), "green" if i % 8 == 1 else "table")
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_an_insult_of_ordinary_words(spark):
    rows, others = spoken(400, 1), spoken(400, 2)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    assert model.phrases.parts == ["green", "table"] and model.phrases.widths == [2]
    more = [(1000, "gr-een table", 1), (1001, "a greeen tabxle here", 1), (1002, "g.r.e.e.n table", 1), (1003, "table of green", 0), (1004, "green. Table", 0), (1005, None, 0), (1006, "", 0)]
    docs = spark.createDataFrame(others + more, "doc_id long, text string, score int").repartition(3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert {i: s >= 0.5 for i, s in got.items()} == {i: bool(y) for i, _, y in others + more}


def test_phrase_margins_against_brute_force():
    rng = np.random.default_rng(8)
    phrases = toxicity.Phrases(["dumb", "green", "table"], [2, 3], rng.normal(size=64**3), 0.1)

    def kernel(phrase):
        codes, total, square = [62, *(0 if c == " " else ord(c) - 96 for c in phrase), 63], 0.0, 0.0
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(i + 7, len(codes))):
                    w = 0.6 ** (k - i + 1)
                    total, square = total + w * phrases.table[(codes[i] * 64 + codes[j]) * 64 + codes[k]], square + w * w
        return total / square**0.5 + 0.1

    for text, windows in [
        ("A green table, dumb thing", ["green table", "table dumb", "green table dumb"]),
        ("green. table", []),
        ("dumb house green of table d.u.m.b", ["green table", "table dumb", "green table dumb"]),
        ("", []),
        ("green " * 500, ["green green", "green green green"]),
    ]:
        assert phrases.margin(text, {}) == pytest.approx(max(map(kernel, windows), default=-np.inf)), text


def test_chance_neighbours_and_copies_are_no_phrases():
    """One toxic text many times over, and clean words that stand together in both classes."""
    rows = labelled(300, seed=4)
    copies = [("unlike pairs follow one another here dumbhead", 1)] * 60
    texts = [(t + " other things", x) for _, t, _, x in rows] + copies
    model = toxicity.train([t for t, _ in texts], [x for _, x in texts])
    assert model.phrases is None


def test_table_equals_the_kernel():
    """The folded table gives the sum of kernels, which equals a plain count over common gapped triples."""

    def plain(a, b):
        def spread(s):
            s, out = f"\x01{s}\x02", {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(i + toxicity.SPAN, len(s))):
                        out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0.0) + toxicity.DECAY ** (k - i + 1)
            return out

        x, y = spread(a), spread(b)
        n = [toxicity._NORM[len(s) + 2] for s in (a, b)]
        return sum(v * y.get(u, 0.0) for u, v in x.items()) / n[0] / n[1]

    landmarks, words = ["idiot", "stupid"], ["idiot", "id1iot", "xstupidx", "harmless", "ab", "a"]
    k = toxicity.kernels(landmarks, words)
    for m, z in enumerate(landmarks):
        for i, w in enumerate(words):
            assert k[i, m] == pytest.approx(plain(w, z), rel=1e-4, abs=1e-6)


def test_quality_held_out(tables):
    rows, docs, labels = tables
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((scores[i] >= 0.7) == bool(q) for i, _, q, _ in held)
    assert len(held) > 60 and right / len(held) > 0.95


def test_votes_equal_brute_force():
    rows = [quality.term_counts(t) for _, t, _, _ in labelled(120, seed=5)]
    labels = [q for _, _, q, _ in labelled(120, seed=5)]
    model = quality.train(rows[:80], labels[:80])
    x = model.project(rows[80:])
    for got, v in zip(model.vote(x), x, strict=True):
        near = sorted(((float(v @ z), y) for z, y in zip(model.vectors, labels, strict=False)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(s, 0.0) ** quality.POWER for s, _ in near]
        assert got == pytest.approx(sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w), abs=1e-4)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_odd_rows(tables, odd, none, op):
    _, docs, labels = tables
    model = op.fit(docs, labels)
    out = op.score(odd, model).collect()
    assert len(out) == 12 and all(0.0 <= r["score"] <= 1.0 for r in out)
    assert {r["score"] < 0.5 for r in out if r["doc_id"] in (1, 2, 3)} == {True}
    assert op.score(none, model).count() == 0
    nothing = op.fit(docs, labels.where("false"))
    assert all(r["score"] < 0.5 for r in op.score(odd, nothing).collect())
    assert op.fit(docs.where("false"), labels) is not None
