"""Operators that bound what a task or a hot key costs, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.operators import explore, lexical, vectors

SPANS = "snapshot_id string, path string, id string, start_byte int, end_byte int"
ASKED = "request_id long, snapshot_id string, path string, byte int"


def nested(rng, begin, end, depth, out):
    """Spans that nest or lie apart, some of them equal or empty."""
    if depth == 0 or end - begin < 2:
        return
    a = begin
    while a < end:
        b = rng.randrange(a, end + 1)
        out += [(a, b)] * rng.choice([1, 1, 2])
        nested(rng, a, b, depth - 1, out)
        a = b + rng.randrange(0, 3) if b > a else a + 1


def test_innermost_spans_against_brute_force(spark):
    rng, spans, asked = random.Random(8), [], []
    for f in range(6):
        found = []
        nested(rng, 0, 120, 4, found)
        spans += [("s", f"f{f}", f"i{n:04d}", a, b) for n, (a, b) in enumerate(found)]
    spans += [("t", "f0", "other", 0, 99)]
    asked = [(i, rng.choice("st"), f"f{rng.randrange(7)}", rng.randrange(-1, 130)) for i in range(900)]
    out = explore.innermost(spark.createDataFrame(asked, ASKED), spark.createDataFrame(spans, SPANS), "id").collect()
    best = {}
    for i, s, p, at in asked:
        around = [(b - a, x) for t, q, x, a, b in spans if (s, p) == (t, q) and a <= at < b]
        if around:
            best[i] = min(around)[1]
    assert {r["request_id"]: r["id"] for r in out} == best and len(out) == len(best)


def test_crossing_spans_are_refused(spark):
    spans = spark.createDataFrame([("s", "f", "a", 0, 10), ("s", "f", "b", 5, 8), ("s", "f", "c", 7, 20)], SPANS)
    with pytest.raises(Exception, match="cross"):
        explore.innermost(spark.createDataFrame([(1, "s", "f", 9)], ASKED), spans, "id").collect()


def test_a_file_with_many_spans_and_positions(spark):
    n = 100_000
    ids = spark.range(n)
    inner = ids.select(F.lit("s").alias("snapshot_id"), F.lit("f").alias("path"), F.col("id").cast("string").alias("id"), (F.col("id") * 10 + 1).cast("int").alias("start_byte"), (F.col("id") * 10 + 6).cast("int").alias("end_byte"))
    whole = spark.createDataFrame([("s", "f", "whole", 0, 10 * n)], SPANS)
    asked = ids.select(F.col("id").alias("request_id"), F.lit("s").alias("snapshot_id"), F.lit("f").alias("path"), (F.col("id") * 10 + F.col("id") % 10).cast("int").alias("byte"))
    found = explore.innermost(asked, inner.unionByName(whole), "id")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftSemi", "")  # positions never meet spans by a join
    got = found.agg(F.count("*"), F.count_if(F.col("id") == F.col("request_id").cast("string")), F.count_if(F.col("id") == "whole")).first()
    assert tuple(got) == (n, n // 2, n // 2)


def test_byte_positions_of_odd_files(spark):
    text = "é1\r\n\n2\x0c3 x"
    files = spark.createDataFrame([("s", "a", text), ("s", "empty", ""), ("s", "null", None)], "snapshot_id string, path string, content string")
    lines = text.splitlines(keepends=True)
    asked, want = [], {}
    for line in range(0, 8):
        for column in range(-1, 6):
            i = len(asked)
            asked.append((i, "s", "a", line, column))
            inside = 1 <= line <= len(lines) and 0 <= column <= len(lines[line - 1].encode())
            want[i] = len("".join(lines[: line - 1]).encode()) + column if inside else None
    for p in ("empty", "null", "none"):
        want[len(asked)] = None
        asked.append((len(asked), "s", p, 1, 0))
    out = explore.byte_positions(spark.createDataFrame(asked, "request_id long, snapshot_id string, path string, line int, column int"), files).collect()
    assert {r["request_id"]: r["byte"] for r in out} == want and all((r["error"] is None) == (r["byte"] is not None) for r in out)


def test_hubs_move_few_edges(spark):
    n, limit = 50_000, 20
    hub = spark.range(n).select(F.lit("s").alias("snapshot_id"), F.col("id").alias("edge_no"), F.lit("call").alias("kind"), F.lit("p").alias("source_path"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("target_path"), F.lit("hub").alias("source_symbol"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("target_symbol"), F.lit(None).cast("string").alias("external_module"), F.lit("resolved").alias("status"))
    own = hub.where("edge_no < 3").withColumns({"edge_no": F.col("edge_no") + n, "target_symbol": F.lit("hub")})  # edges from the hub to itself count once
    asked = spark.createDataFrame([(i, "s", None, "hub") for i in range(30)] + [(99, "s", "p", None)], "request_id long, snapshot_id string, path string, symbol_id string")
    found = explore.graph_neighbors(asked, hub.unionByName(own), limit)
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.groupBy("request_id").agg(F.count("*").alias("n"), F.max("edge_no").alias("last"), F.min("truncated").alias("cut")).collect()
    assert len(got) == 31 and all((r["n"], r["last"], r["cut"]) == (limit, limit - 1, True) for r in got)


def chunks_of(spark, texts):
    rows = [("s" if i % 5 else "t", f"c{i:05d}", f"dir{i % 3}/f{i}", "en" if i % 2 else "de", "sym" if i % 7 == 0 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "snapshot_id string, id string, path string, language string, symbol string, excerpt string"), rows


@pytest.mark.parametrize("sizes", [(512, 32, 1024), (4, 2, 3)])
def test_blocks_give_what_all_postings_give(spark, sizes, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TILE", sizes[2])
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(0, 30))) for _ in range(400)]
    chunks, rows = chunks_of(spark, texts)
    index, lengths = lexical.postings(chunks), lexical.document_lengths(chunks)
    asked = [(q, rng.choice("st"), " ".join(rng.choices([*words, "nowhere", "dir1"], k=rng.randrange(1, 9))), rng.choice([None, "", "en", "xx"]), rng.choice([None, "dir1", "dir"])) for q in range(40)]
    queries = spark.createDataFrame(asked, "query_id long, snapshot_id string, query string, language string, path_prefix string")
    got = {}
    for r in lexical.bm25(index, lengths, queries, top=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    post = {(r["snapshot_id"], r["term"], r["chunk_id"]): 2 * r["tf_path"] + 4 * r["tf_symbol"] + r["tf_code"] for r in index.collect()}
    size = {(r["snapshot_id"], r["chunk_id"]): r["n_tokens"] for r in lengths.collect()}
    for q, s, query, language, prefix in asked:
        own = {c: n for (t, c), n in size.items() if t == s}
        average, scored = sum(own.values()) / len(own), []
        for _, c, path, lang, *_ in (r for r in rows if r[0] == s):
            total, hit = 0.0, False
            for term in dict.fromkeys(query.lower().split()):
                df = sum(1 for (t, w, _) in post if (t, w) == (s, term))
                if f := post.get((s, term, c)):
                    idf = np.log((len(own) - df + 0.5) / (df + 0.5))
                    total, hit = total + (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * own[c] / average)), True
            if hit and language in (None, "", lang) and path.startswith(prefix or ""):
                scored.append((-round(total, 9), c))
        want = [(k, c, -x) for k, (x, c) in enumerate(sorted(scored)[:7], 1)]
        assert [x[:2] for x in sorted(got.get(q, []))] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-9 for a, b in zip(sorted(got.get(q, [])), want, strict=True))


def test_bounds_leave_blocks_out(spark):
    """Chunks of one directory are alike: only its blocks can hold the best."""
    texts = [(f"topic{i // 512} " * (3 + i % 4)) + "common filler words here" for i in range(16_000)]
    rows = [("s", f"c{i:05d}", f"dir{i // 512:03d}/f{i}", "en", None, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "snapshot_id string, id string, path string, language string, symbol string, excerpt string")
    built = lexical.blocked(lexical.postings(chunks), lexical.document_lengths(chunks))
    queries = spark.createDataFrame([(i, "s", f"topic{i} common words", None, None) for i in range(20)], "query_id long, snapshot_id string, query string, language string, path_prefix string")
    counts = lexical.blocks_scored(built, queries).collect()
    assert len(counts) == 20 and sum(r["n_scored"] for r in counts) < 0.2 * sum(r["n_blocks"] for r in counts)
    assert {r["chunk_id"] for r in lexical.bm25_of_blocks(built, queries).where("query_id = 3").collect()} <= {f"c{i:05d}" for i in range(3 * 512, 4 * 512)}


@pytest.mark.parametrize("tiles", [(4096, 65_536), (7, 50)])
def test_vector_tiles_against_brute_force(spark, tiles):
    rng = np.random.default_rng(4)
    v = rng.integers(-1, 2, (300, 4)).astype(np.float32)  # many ties
    rows = [("s" if i % 4 else "t", f"c{i:04d}", f"d{i % 3}/x", "en" if i % 2 else "de", v[i].tolist() if i != 9 else None) for i in range(300)]
    asked = [(q, "s" if q % 3 else "t", rng.normal(size=4).tolist() if q % 5 else v[q].tolist(), [None, "", "en"][q % 3], [None, "d1", ""][q % 2]) for q in range(60)]
    held = spark.createDataFrame(rows, "snapshot_id string, chunk_id string, path string, language string, vector array<float>")
    queries = spark.createDataFrame(asked, "query_id long, snapshot_id string, vector array<double>, language string, path_prefix string")
    got = {}
    for r in vectors.vector_topk(held, queries, 12, *tiles).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    unit = lambda x: np.asarray(x, dtype=float) / max(np.linalg.norm(x), 1e-300)
    for q, s, x, language, prefix in asked:
        fit = [(-round(float(unit(x) @ unit(w)), 6) + 0.0, c) for t, c, p, lang, w in rows if t == s and w is not None and language in (None, "", lang) and p.startswith(prefix or "")]
        assert sorted(got[q]) == [(k, c) for k, (_, c) in enumerate(sorted(fit)[:12], 1)]
    assert vectors.vector_topk(held, queries.where("false"), 5).count() == 0 == vectors.vector_topk(held.where("false"), queries, 5).count()
