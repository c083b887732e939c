import ast
import random
import sqlite3
from pathlib import Path

import pytest

from codelake.functions.storage import settle
from codelake.functions.text import code_terms
from codelake.operators import binding, chunking, evidence, explore, lexical, structure
from codelake.operators.vectors import HashedEncoder
from codelake.plans import workloads

from . import structure_by_walk

FILES = {
    "pkg/util.py": "def helper(x):\n    return x\n\n\nclass Box:\n    def open(self):\n        return helper(self)\n",
    "pkg/main.py": "from .util import helper as h\nimport pkg.util\n\n\ndef run():\n    return h(1)\n\n\ndef shadow(h):\n    return h(2)\n\n\ndef whole():\n    return pkg.util.helper(3)\n",
    "twice.py": "def f():\n    pass\n\n\ndef f():\n    pass\n\n\nf()\n",
    "reassigned.py": "import os\n\ng = lambda name: name\ng = 5\ng()\nobj.run()\n",
    "broken.py": "# é comment\ndef login(user):\n    return user\n\n\ndef half(:\n    login(1)\n",
    "notes.txt": "plain words here\n",
}


def raw(spark, files, snapshot="s1"):
    return spark.createDataFrame([("r", snapshot, p, t.encode()) for p, t in files.items()], "repository_id string, snapshot_id string, path string, content binary")


def caches(spark):
    arrays = structure.extract_structure(raw(spark, {}).selectExpr("snapshot_id", "path", "string(content) content", "path language", "path content_hash")).schema
    kinds = ", ".join(f"{k} {arrays[k].dataType.simpleString()}" for k in ("nodes", *structure.SCHEMAS))
    return spark.createDataFrame([], f"key string, {kinds}"), spark.createDataFrame([], "key string, vector array<float>")


@pytest.fixture(scope="module")
def index(spark):
    return workloads.index_snapshots(raw(spark, FILES), *caches(spark))


def plain(rows, kind):
    names = [x.split()[0] for x in structure.SCHEMAS[kind].split(", ")]
    return sorted(([r[n] for n in names] for r in rows), key=repr)


MEMBERS = "import a.b\ndef f():\n    global G, \\\n  É\n    a.b.c(k=1)\n    try:\n        pass\n    except (E, as_) as err:\n        err.x = 2\nf = 3\n"
ODD = {
    "m.py": MEMBERS, "empty.py": "", "open.py": "(", "many.py": "x = (\n" * 3, "nul.py": "\0", "crlf.py": "def a(x=lambda y=b: z):\r\n  @d(1)\r\n  class é(q, k=é):\r\n    v: int = w\r\n    u += 1\r\n    return_ = lambda *a, **k: (a, k)\r\n  return é().v.w(x)(y)\r\n",
    "deep.py": "\n".join("    " * i + f"def f{i}(a{i}: T = D, *, k=lambda p: p.q):" for i in range(12)) + "\n" + "    " * 12 + "x = y = f0.a.b(x, key=f1(y))\n", "star.py": "from . import *\nfrom ..p import q as r, s\nimport a.b.c, d as e\n",
    "new.py": "def g[T: (int, U)](x: T) -> T:\n    match x:\n        case {'a': P(b=c)} if d: pass\n    with a() as b, c: del b\n    return f'{x!r:>{w}} {y.z()}'\n",
}


def test_nodes_give_what_a_walk_of_each_file_gives(spark):
    here = Path(ast.__file__).parent
    files = {p: (here / p).read_text() for p in ("ast.py", "functools.py", "dataclasses.py", "contextlib.py", "argparse.py", "asyncio/tasks.py")} | ODD | {p: t for p, t in FILES.items() if p.endswith(".py")}
    rows = [("s", p, t, "python", "h") for p, t in files.items()]
    parsed = structure.extract_structure(spark.createDataFrame(rows, "snapshot_id string, path string, content string, language string, content_hash string").repartition(5))
    tables = {kind: df.collect() for kind, df in structure.tables_of(settle(parsed)).items()}
    for path, text in files.items():
        walked = structure_by_walk.extract_python(path, text)
        for kind in structure.SCHEMAS:
            assert plain([r for r in tables[kind] if r["path"] == path], kind) == plain(walked[kind], kind), (path, kind)


def rows_of(spark, path, text):
    parsed = structure.extract_structure(spark.createDataFrame([("s", path, text, "python", "h")], "snapshot_id string, path string, content string, language string, content_hash string"))
    return {kind: df.collect() for kind, df in structure.tables_of(settle(parsed)).items()}


def test_python_structure(spark):
    rows = rows_of(spark, "pkg/util.py", FILES["pkg/util.py"])
    symbols = {s["qualified_name"]: s for s in rows["symbols"]}
    assert {k: v["kind"] for k, v in symbols.items()} == {"helper": "function", "Box": "class", "Box.open": "method"}
    assert symbols["helper"]["locals"] == ["x"] and symbols["helper"]["signature"] == "def helper(x):"
    assert symbols["Box.open"]["scope"] == symbols["Box"]["id"] and symbols["Box.open"]["export_names"] == ["open"]
    text = FILES["pkg/util.py"].encode()
    for r in rows["refs"]:
        assert text[r["start_byte"] : r["end_byte"]].decode() == r["name"]
    assert [(r["name"], r["role"]) for r in sorted(rows["refs"], key=lambda r: r["ref_no"])] == [("x", "reference"), ("helper", "call"), ("self", "reference")]


def test_members_and_words_of_statements(spark):
    rows = rows_of(spark, "m.py", MEMBERS)
    refs = [(r["name"], r["role"], r["member_base"]) for r in rows["refs"]]
    assert ("c", "call", "a.b") in refs and ("k", "reference", None) in refs and ("G", "reference", None) in refs and ("err", "reference", None) in refs
    assert ("b", "reference", "a") in refs and ("f", "reference", None) in refs
    assert [(i["module"], i["name"], i["alias"]) for i in rows["imports"]] == [("a.b", None, "a")]
    assert {b["name"] for b in rows["barriers"]} == {"f"}


def test_broken_files_keep_what_precedes_the_error(spark):
    rows = rows_of(spark, "broken.py", FILES["broken.py"])
    assert [s["name"] for s in rows["symbols"]] == ["login"] and rows["symbols"][0]["start_line"] == 2
    assert FILES["broken.py"].encode()[rows["symbols"][0]["start_byte"] :].startswith(b"def login")
    (error,) = rows["diagnostics"]
    assert error["kind"] == "syntax-error" and all(not error["start_byte"] <= r["start_byte"] < error["end_byte"] for r in rows["refs"])


def test_another_extractor_fills_the_same_tables(spark):
    place = {"start_byte": 0, "end_byte": 3, "start_line": 1, "end_line": 1, "column": 0}
    made = lambda path, text: {"symbols": [{"id": path, "name": "n", "qualified_name": "n", "kind": "function", "scope": None, "locals": ["l"], "signature": text, "exported": True, "export_names": ["default"], **place}], "barriers": [{"name": "b", "scope": None}]}
    files = spark.createDataFrame([("s", "a.ts", "let", "typescript", "h"), ("s", "b.py", "x", "python", "h")], "snapshot_id string, path string, content string, language string, content_hash string")
    tables = structure.tables_of(settle(structure.extract_structure(files, {"typescript": made})))
    assert [(r["path"], r["signature"], r["locals"]) for r in tables["symbols"].collect()] == [("a.ts", "let", ["l"])]
    assert [r["path"] for r in tables["barriers"].collect()] == ["a.ts"] and [r["path"] for r in tables["refs"].collect()] == ["b.py"]


def test_binding(index):
    refs = {}
    for r in index.refs.collect():
        refs.setdefault((r["path"], r["name"], r["start_line"]), []).append(r["status"])
    assert refs["pkg/main.py", "h", 6] == ["resolved"] and refs["pkg/main.py", "h", 10] == ["unresolved"]
    assert refs["pkg/main.py", "helper", 14] == ["resolved"]
    assert refs["twice.py", "f", 9] == ["candidate"]
    assert refs["reassigned.py", "g", 5] == ["unresolved"] and refs["reassigned.py", "run", 6] == ["unresolved"]
    edges = {(e["kind"], e["source_path"], e["target_path"]) for e in index.edges.where("status = 'resolved'").collect()}
    assert ("import", "pkg/main.py", "pkg/util.py") in edges and ("call", "pkg/main.py", "pkg/util.py") in edges and ("contains", "pkg/util.py", "pkg/util.py") in edges


def script_tables(spark):
    """Two files that re-export all of each other, and an index that renames; as another extractor would give them."""
    symbols = [("s", "src/a.ts", "A", "alpha", "alpha", None, [], ["alpha"]), ("s", "src/b.ts", "B", "beta", "beta", None, [], ["beta"])]
    imports = [
        ("s", "src/a.ts", "./b", None, None, None, True), ("s", "src/b.ts", "./a", None, None, None, True), ("s", "src/index.ts", "./a.js", "alpha", "first", None, True),
        ("s", "use.tsx", "@app/a", "beta", "x", None, False), ("s", "use.tsx", "@app", "first", "y", None, False), ("s", "use.tsx", "@app/b", "*", "n", None, False), ("s", "use.tsx", "react", "default", "React", None, False),
    ]
    refs = [("s", "use.tsx", i, n, None, "call", b is not None, b) for i, (n, b) in enumerate([("x", None), ("y", None), ("alpha", "n"), ("React", None), ("alpha", "other")])]
    files = [("s", p, "typescript") for p in ("src/a.ts", "src/b.ts", "src/index.ts", "use.tsx")]
    return (
        spark.createDataFrame(files, "snapshot_id string, path string, language string"),
        spark.createDataFrame(symbols, "snapshot_id string, path string, id string, name string, qualified_name string, scope string, locals array<string>, export_names array<string>"),
        spark.createDataFrame(imports, "snapshot_id string, path string, module string, name string, alias string, scope string, reexport boolean"),
        spark.createDataFrame(refs, "snapshot_id string, path string, ref_no int, name string, scope string, role string, member boolean, member_base string"),
        spark.createDataFrame([], "snapshot_id string, path string, name string, scope string"),
        spark.createDataFrame([("s", "", {"@app/*": ["src/*"], "@app": ["src"]})], "snapshot_id string, base_url string, paths map<string, array<string>>"),
    )


def test_scripts_cycles_and_path_mapping(spark):
    files, symbols, imports, refs, barriers, config = script_tables(spark)
    bound, edges = binding.bind(files, symbols, imports, refs, barriers, config)
    got = {r["ref_no"]: (r["status"], r["target"]) for r in bound.collect()}
    assert got == {0: ("resolved", "B"), 1: ("resolved", "A"), 2: ("resolved", "A"), 3: ("unresolved", None), 4: ("unresolved", None)}
    outside = edges.where("external_module is not null").collect()
    assert [(e["external_module"], e["status"]) for e in outside] == [("react", "unresolved")]


def test_python_module_candidates(spark):
    rows = [("a/b/c.py", ".x"), ("a/b/c.py", "..x.y"), ("a/b/c.py", "."), ("a/b/c.py", "p.q"), ("c.py", "...z")]
    df = spark.createDataFrame(rows, "path string, module string")
    got = [r[0] for r in df.select(binding.python_candidates(df.path, df.module)).collect()]
    assert got == [["a/b/x.py", "a/b/x/__init__.py"], ["a/x/y.py", "a/x/y/__init__.py"], ["a/b/__init__.py"], ["p/q.py", "p/q/__init__.py", "src/p/q.py", "src/p/q/__init__.py"], ["z.py", "z/__init__.py"]]


def test_windows():
    text = "\n".join(" ".join(f"t{i}_{j}" for j in range(100)) for i in range(20))
    windows = list(chunking.split_windows(text, None, 512, 64))
    assert len(windows) > 1 and windows[-1][1] == len(text) and all(len(text[a:b].split()) <= 512 for a, b in windows)
    code = "a = 1 ;\ncall( " + " , ".join("x" * 3 for _ in range(20)) + " )"
    first = code.index(";") + 1
    windows = list(chunking.split_windows(code, [first, len(code)], 12, 2))
    assert code[slice(*windows[0])] == "a = 1 ;" and all(len(code[a:b].split()) <= 12 for a, b in windows)
    rng = random.Random(3)
    for _ in range(200):  # progress and cover, whatever the ends
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randrange(200)))
        ends = None if rng.random() < 0.5 else [rng.randrange(201) for _ in range(rng.randrange(6))]
        spans, budget = chunking.token_spans(text), rng.randrange(2, 9)
        windows = list(chunking.split_windows(text, ends, budget, rng.randrange(budget)))
        assert {i for i, (a, b) in enumerate(spans) if any(x <= a and b <= y for x, y in windows)} == set(range(len(spans)))
        assert all(p[0] < q[0] for p, q in zip(windows, windows[1:]))


def test_chunks_have_places(index):
    for c in index.chunks.collect():
        raw_ = FILES[c["path"]].encode()
        assert raw_[c["start_byte"] : c["end_byte"]].decode() == c["excerpt"]
        assert c["start_line"] == raw_[: c["start_byte"]].count(b"\n") + 1 and c["end_line"] == raw_[: c["end_byte"]].count(b"\n") + 1
    box = [c["excerpt"] for c in index.chunks.where("symbol = 'Box'").collect()]
    assert box == ["class Box:"]


def test_terms(spark):
    df = spark.createDataFrame([("parseHTTPRequest2Go snake_case é-x ÀB",), (None,)], "t string")
    assert [r[0] for r in df.select(code_terms("t")).collect()] == [["parse", "httprequest2", "go", "snake", "case", "x", "b"], []]


def test_bm25_against_sqlite(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i:03}", f"d/{rng.choice(words)}.py", rng.choice([None, *words]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, path, symbol, code, tokenize='ascii')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO t VALUES (?,?,?,?)", [(i, p.replace("/", " ").replace(".", " "), s or "", c) for i, p, s, c in rows])
    chunks = spark.createDataFrame([("s", *r, "python") for r in rows], "snapshot_id string, id string, path string, symbol string, excerpt string, language string")
    asked = [(n, "s", " ".join(rng.choice(words) for _ in range(3)), None, None) for n in range(8)]
    queries = spark.createDataFrame(asked, "query_id long, snapshot_id string, query string, language string, path_prefix string")
    out = lexical.bm25(lexical.postings(chunks), lexical.document_lengths(chunks), queries).collect()
    for n, _, text, _, _ in asked:
        expression = " OR ".join(f'"{w}"' for w in dict.fromkeys(text.split()))
        want = {i: -s for i, s in db.execute("SELECT id, bm25(t,0,2,4,1) FROM t WHERE t MATCH ?", (expression,))}
        got = {r["chunk_id"]: r["score"] for r in out if r["query_id"] == n}
        assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got) and len(got) == min(100, len(want))


@pytest.mark.parametrize("strategy", ["bm25", "vector-only", "hybrid", "ast-aware"])
def test_strategies(spark, index, strategy):
    rows = [(1, "s1", "helper", None, None), (2, "s1", "helper", "typescript", None), (3, "s1", "helper", None, "nowhere/"), (4, "s1", "run whole main", None, None), (5, "s1", " ", None, None), (6, "s9", "helper", None, None)]
    queries = spark.createDataFrame(rows, "query_id long, snapshot_id string, query string, language string, path_prefix string")
    out = workloads.search_index(index, queries, strategy, 10).collect()
    assert {r["query_id"] for r in out} == {1, 4}
    if strategy != "vector-only":
        best = min((r for r in out if r["query_id"] == 1), key=lambda r: r["rank"])
        assert best["symbol"] == "helper" or strategy == "bm25"
    if strategy == "ast-aware":
        assert any("dependency-expansion" in r["origins"] for r in out if r["query_id"] == 4)
        assert any("exact-symbol" in r["origins"] for r in out if r["query_id"] == 1)
    with pytest.raises(ValueError, match="strategy"):
        workloads.search_index(index, queries, "other", 10)


def test_reuse_and_new_snapshot(spark, index):
    more = FILES | {"new.py": "from pkg.util import helper\nhelper(1)\n"}
    again = workloads.index_snapshots(raw(spark, more, "s2"), index.parsed_cache, index.embedding_cache)
    assert again.parsed_cache.count() == 1
    hits = again.vectors.groupBy("embedding_hit").count().collect()
    assert {r[0]: r[1] for r in hits}[True] == index.chunks.count()
    assert workloads.snapshot_metrics(again).first()["content_manifest_hash"] != workloads.snapshot_metrics(index).first()["content_manifest_hash"]


def test_evaluation_of_an_index(spark, index):
    queries = spark.createDataFrame([(1, "s1", "helper", None, None)], "query_id long, snapshot_id string, query string, language string, path_prefix string")
    ranges = spark.createDataFrame([(1, "s1", "pkg/util.py", 1, 2)], "query_id long, snapshot_id string, path string, start_line int, end_line int")
    out = {r["strategy"]: r for r in workloads.evaluate_index(index, queries, ranges).collect()}
    assert len(out) == 4 and out["ast-aware"]["mrr_10"] == 1.0


def test_definitions_and_references(spark, index):
    rows = [(1, "s1", "pkg/main.py", 6, 11), (2, "s1", "pkg/main.py", 5, 5), (3, "s1", "pkg/main.py", 99, 0), (4, "s1", "pkg/util.py", 7, 15)]
    asked = explore.byte_positions(spark.createDataFrame(rows, "request_id long, snapshot_id string, path string, line int, column int"), index.files)
    assert {r["request_id"] for r in asked.where("error is not null").collect()} == {3}
    out = {r["request_id"]: r for r in explore.definition_at(asked, index.refs, index.symbols).collect()}
    names = {r["id"]: r["qualified_name"] for r in index.symbols.collect()}
    assert [[names[d] for d in out[i]["definitions"]] for i in (1, 2, 4)] == [["helper"], ["run"], ["helper"]] and out[3]["status"] == "unresolved"
    helper = next(i for i, n in names.items() if n == "helper")
    targets = spark.createDataFrame([(1, "s1", helper), (2, "s1", "none")], "request_id long, snapshot_id string, symbol_id string")
    assert {(r["path"], r["start_line"] if "start_line" in r else None) for r in explore.references_to(targets, index.refs).collect()} == {("pkg/main.py", None), ("pkg/util.py", None)}
    found = explore.definition_by_id(targets, index.symbols).collect()
    assert {r["request_id"]: r["error"] is None for r in found} == {1: True, 2: False}


def test_graph(spark, index):
    rows = [(1, "s1", "pkg/main.py", None), (2, "s1", None, None), (3, "s1", None, "nope")]
    asked = spark.createDataFrame(rows, "request_id long, snapshot_id string, path string, symbol_id string")
    out = explore.graph_neighbors(asked, index.edges, 2)
    assert out.count() == 2 and all(r["truncated"] for r in out.collect())
    nodes = explore.graph_nodes(explore.graph_neighbors(asked, index.edges), index.symbols).collect()
    assert {"run", "helper"} <= {r["label"] for r in nodes}
    assert {r["request_id"] for r in explore.graph_errors(asked, index.symbols, index.files).collect()} == {2, 3}
    with pytest.raises(ValueError, match="limit"):
        explore.graph_neighbors(asked, index.edges, 501)


def test_file_slices(spark):
    files = spark.createDataFrame([("s", "a.txt", "1\r\n2\x0c3 4\n", "h", "text"), ("s", "empty", "", "h", "text")], "snapshot_id string, path string, content string, content_hash string, language string")
    rows = [(1, "a.txt", 2, 3), (2, "a.txt", 1, None), (3, "a.txt", 1, 99), (4, "../a.txt", 1, 1), (5, "/a.txt", 1, 1), (6, "none", 1, 1), (7, "empty", 1, None), (8, "a.txt", 3, 2)]
    asked = spark.createDataFrame([(i, "s", p, a, b) for i, p, a, b in rows], "request_id long, snapshot_id string, path string, start_line int, end_line int")
    out = {r["request_id"]: r for r in explore.file_slice(asked, files).collect()}
    assert out[1]["content"] == "2\n3" and out[2]["content"] == "1\n2\n3\n4" and (out[7]["content"], out[7]["total_lines"]) == ("", 0)
    assert all(out[i]["error"] and out[i]["content"] is None for i in (3, 4, 5, 6, 8))


def test_evidence_and_replies(spark):
    hits = spark.createDataFrame([(1, r, f"c{r}", n) for r, n in enumerate([5, 9, 3, 2], 1)], "query_id long, rank int, chunk_id string, n_tokens int")
    packed = evidence.pack_evidence(hits, spark.createDataFrame([(1, 10)], "query_id long, budget int"))
    assert tuple(packed.first()) == (1, ["c1", "c3", "c4"], 10)
    replies = [
        (1, '```json\n{"answer": "x [c1]", "citations": ["c1", "c1"]}\n```', "answered"), (2, '{"answer": "x [zz]", "citations": ["zz"]}', "unavailable"), (3, None, "unavailable"),
        (4, '{"answer": "x", "citations": []}', "insufficient-evidence"), (5, '{"answer": 5, "citations": []}', "unavailable"), (6, '{"answer": "x [c1]", "citations": "c1"}', "unavailable"), (7, "[]", "unavailable"),
    ]
    known = spark.createDataFrame([(i, ["c1", "c2"], 3) for i, _, _ in replies] + [(8, [], 0)], "query_id long, chunk_ids array<string>, tokens long")
    out = {r["query_id"]: r for r in evidence.check_replies(spark.createDataFrame([r[:2] for r in replies], "query_id long, raw string"), known).collect()}
    assert {i: out[i]["status"] for i in out} == {i: s for i, _, s in replies} | {8: "insufficient-evidence"}
    assert out[1]["citations"] == ["c1"] and out[2]["citations"] == []


def test_encoder_gives_unit_vectors():
    v = HashedEncoder(16).encode([["a", "b"], []])
    assert abs(float((v[0] ** 2).sum()) - 1) < 1e-9 and not v[1].any()
