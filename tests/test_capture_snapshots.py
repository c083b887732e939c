import datetime as dt
import fnmatch
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from codelake.functions.text import glob_regex, identity, language_of
from codelake.operators import evaluate, reports
from codelake.sources import capture, snapshots

SNAP = "id string, repository_id string, commit_sha string, status string, created_at timestamp"


def test_skip_reasons_in_order(spark):
    big = b"x" * 1_000_001
    rows = [
        ("a/node_modules/x.js", b"ok", False, True, "excluded-path"), ("docs/a/b.md", b"ok", False, True, "excluded-path"), ("link.py", b"ok", True, True, "symlink-or-outside-root"),
        ("gone.py", None, False, False, "deleted-or-non-file"), ("big.txt", big, False, True, "larger-than-1MB"), ("b.bin", b"a\0b", False, True, "binary"),
        ("latin.txt", b"caf\xe9", False, True, "not-utf8"), ("gen.py", b"# @GENERATED by x\n", False, True, "generated"), ("late.py", b" " * 2100 + b"@generated", False, True, None),
        ("empty.py", b"", False, True, None), ("node_modules.py", b"ok", False, True, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "path string, content binary, is_symlink boolean, exists boolean")
    got = {r["path"]: r["reason"] for r in capture.with_reason(df, ["docs/*"]).collect()}
    assert got == {r[0]: r[4] for r in rows}
    files, skipped = capture.capture(df, ["docs/*"])
    assert files.count() == 3 and {r["reason"]: r["n_files"] for r in capture.skip_report(skipped).collect()}["excluded-path"] == 2


def test_decoding(spark):
    raw = "﻿é = 1\n".encode()
    row = capture.decoded(spark.createDataFrame([("a.py", raw)], "path string, content binary")).first()
    assert row["content"] == "é = 1\n" and row["content_hash"] == hashlib.sha256(raw).hexdigest() and row["language"] == "python"


def test_read_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    assert {r["path"] for r in capture.read_tree(spark, str(tmp_path)).collect()} == {"pkg/a.py", "b.txt"}
    tracked = spark.createDataFrame([("b.txt",), ("gone.py",)], "path string")
    assert {r["path"]: r["exists"] for r in capture.read_tree(spark, str(tmp_path), tracked).collect()} == {"b.txt": True, "gone.py": False}


@pytest.mark.parametrize("pattern", ["*.py", "src/*", "a?c", "[ab]*.ts", "[!a]*", "*/de/*7.txt", "x[", "a.b", "[]x]*", "a\\b"])
def test_globs(pattern):
    for path in ["a.py", "src/x/y.py", "abc", "a.ts", "b/x.ts", "c", "q/de/17.txt", "x[", "a.b", "axb", "]q", "xq", "a\\b"]:
        assert bool(re.search(glob_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern), path


def test_languages_and_identity(spark):
    paths = ["a.py", "b/c.tsx", ".py", "x.PY", "d.test.js", "y.jsx", "z.ts", "README", "a.py/b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(language_of("path")).collect()] == ["python", "tsx", "text", "text", "javascript", "javascript", "typescript", "text", "text"]
    want = hashlib.sha256(b"a.py\x003\x00\x00f").hexdigest()[:32]
    assert df.limit(1).select(identity("path", F.lit(3), F.lit(None), F.lit("f"))).first()[0] == want


def test_source_urls(spark):
    good = {"https://github.com/o/n": "n", "https://github.com/o/n.git": "n", " https://github.com/o/n.x/ ": "n.x"}
    bad = ["http://github.com/o/n", "https://u:p@github.com/o/n", "https://gitlab.com/o/n", "https://github.com/o/n?x=1", "https://github.com/../n", "https://github.com/o/..", "--upload-pack=x", "https://github.com/o/n/m"]
    df = spark.createDataFrame([("github", s) for s in [*good, *bad]] + [("ftp", "x")], "kind string, source string")
    ok, errors = capture.normalize_sources(df)
    assert {(r["source"], r["name"]) for r in ok.collect()} == {("https://github.com/o/n.git", "n"), ("https://github.com/o/n.x.git", "n.x")}
    assert errors.count() == len(bad) + 1


def test_register_keeps_known_rows(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "id string, source string, imported_at timestamp"
    old = spark.createDataFrame([("1", "a", at(5))], schema)
    new = spark.createDataFrame([("2", "a", at(1)), ("4", "b", at(3)), ("3", "b", at(2))], schema)
    assert [(r["id"], r["source"]) for r in capture.list_sources(capture.register_sources(old, new)).collect()] == [("3", "b"), ("1", "a")]


def test_manifest_is_the_hash_of_a_sorted_object(spark):
    rows = [("s", 'q"x.py', "h2"), ("s", "a/é.py", "h1"), ("t", "a", "h")]
    got = {r["snapshot_id"]: r["content_manifest_hash"] for r in snapshots.manifest(spark.createDataFrame(rows, "snapshot_id string, path string, content_hash string"), "snapshot_id").collect()}
    body = json.dumps({"a/é.py": "h1", 'q"x.py': "h2"}, ensure_ascii=False)
    assert got["s"] == hashlib.sha256(body.encode()).hexdigest() and len(got) == 2


def test_publish_again_after_a_failure(spark, tmp_path):
    root, keys = str(tmp_path), "repository_id string, snapshot_id string"
    files = spark.createDataFrame([("01", "007", "a.py"), ("01", "007", "b.py")], f"{keys}, path string")
    chunks = spark.createDataFrame([("01", "007", i) for i in range(5)], f"{keys}, n int")
    row = lambda day, status="ready": spark.createDataFrame([("007", "01", "c", status, dt.datetime(2024, 1, day))], SNAP)
    old = spark.createDataFrame([("01", "006", "old.py")], f"{keys}, path string")
    snapshots.publish(spark, root, {"files": old, "chunks": chunks.withColumn("snapshot_id", F.lit("006"))}, row(1).withColumn("id", F.lit("006")))
    failing = chunks.withColumn("n", F.when(F.col("n") > 3, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(spark, root, {"files": files, "chunks": failing}, row(2))
    assert [r["path"] for r in snapshots.read_ready(spark, root, "files").collect()] == ["old.py"]  # older ones stay as they were
    snapshots.publish(spark, root, {"files": files, "chunks": chunks}, row(2))
    got = snapshots.read_ready(spark, root, "files")
    assert sorted(map(tuple, got.select("repository_id", "snapshot_id", "path").collect())) == [("01", "006", "old.py"), ("01", "007", "a.py"), ("01", "007", "b.py")]
    assert snapshots.read_ready(spark, root, "chunks").count() == 10
    second = snapshots.publish(spark, root, {"files": files.where("path = 'a.py'"), "chunks": chunks}, row(2))  # as after a commit whose answer was lost
    assert sorted(r["path"] for r in snapshots.read_ready(spark, root, "files").collect()) == ["a.py", "old.py"] and snapshots.listed(spark, root).count() == 2
    assert snapshots.sweep(spark, root, "files", running=[second]) == 2  # the failed attempt, and the one that was replaced
    assert snapshots.sweep(spark, root, "chunks") == 1  # Spark has taken back what the failed task wrote
    assert sorted(r["path"] for r in snapshots.read_ready(spark, root, "files").collect()) == ["a.py", "old.py"] and snapshots.read_ready(spark, root, "chunks").count() == 10
    assert snapshots.sweep(spark, root, "files", keep=1) == 1 and [r["path"] for r in snapshots.read_ready(spark, root, "files", keep=1).collect()] == ["a.py"]
    snapshots.publish(spark, root, {"files": files}, row(3, "failed"))
    assert "b.py" not in {r["path"] for r in snapshots.read_ready(spark, root, "files").collect()}


def test_publish_retention_and_reading(spark, tmp_path):
    root = str(tmp_path)
    for n in range(1, 4):
        files = spark.createDataFrame([("r", f"s{n}", f"f{n}.py")], "repository_id string, snapshot_id string, path string")
        row = spark.createDataFrame([(f"s{n}", "r", "c", "ready", dt.datetime(2024, 1, n))], SNAP)
        snapshots.publish(spark, root, {"files": files}, row)
    # an unfinished snapshot has data, but no row
    snapshots.stage(spark.createDataFrame([("r", "s9", "half.py")], "repository_id string, snapshot_id string, path string"), root, "files", "broken")
    assert {r["path"] for r in snapshots.read_ready(spark, root, "files").collect()} == {"f1.py", "f2.py", "f3.py"}
    kept = snapshots.retention(snapshots.listed(spark, root))
    assert {r["id"]: r["status"] for r in kept.collect()} == {"s1": "retired", "s2": "ready", "s3": "ready"}
    assert [r["id"] for r in snapshots.history(kept).collect()] == ["s3", "s2", "s1"]
    files = spark.read.parquet(f"{root}/files")
    assert "f1.py" not in {r["path"] for r in snapshots.without_retired(files, kept).collect()}
    asked = spark.createDataFrame([("r", "s1"), ("r", "s2"), ("x", "s2")], "repository_id string, snapshot_id string")
    good, bad = snapshots.require_ready(asked, kept)
    assert [r["snapshot_id"] for r in good.collect()] == ["s2"] and bad.count() == 2


def test_recovery_and_reusable_runs(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"s{n}", "r", "c", "structured" if n == 1 else "ready", at + dt.timedelta(n)) for n in range(1, 5)], SNAP)
    failed = spark.createDataFrame([("s1",), ("s2",)], "snapshot_id string")
    assert {r["id"]: r["status"] for r in snapshots.recover_interrupted(df, failed).collect()}["s1"] == "failed"
    row = snapshots.reusable_runs(df, "commit_sha").first()
    assert (row["full_id"], row["incremental_id"]) == ("s3", "s4")


def test_module_config(spark):
    rows = [("s", "tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"]}}}'), ("t", "tsconfig.json", "{ // no"), ("s", "x/tsconfig.json", "{}")]
    configs, skips = capture.read_module_config(spark.createDataFrame(rows, "snapshot_id string, path string, content string"))
    assert configs.first()["paths"] == {"@app/*": ["src/*"]} and [r["reason"] for r in skips.collect()] == ["unsupported-config-syntax"]


def test_reports(spark, tmp_path):
    quality = {"recall@5": 0.5, "recall@10": 1, "recall@20": 1, "mrr@10": 0.25, "p50_ms": 3.5, "p95_ms": 9}
    index = {"files": 3, "chunks": 9, "total_seconds": 1.5, "peak_rss_bytes": 7, "skipped": [{"path": "a"}, {"path": "b"}]}
    good = {"status": "confirmed", "split": "test", "summary": {"bm25": quality}, "hardware": {"cpu": "x"}, "indexing": {"r": index}}
    bad = [good | {"summary": {"bm25": quality | {"p50_ms": "fast"}}}, good | {"summary": {"bm25": quality | {"mrr@10": True}}}, [1], {k: v for k, v in good.items() if k != "split"}, good | {"hardware": 1}]
    for n, body in enumerate([good, good | {"summary": {}, "indexing": {}}, *bad]):
        (tmp_path / f"r{n}").mkdir()
        (tmp_path / f"r{n}/results.json").write_text(json.dumps(body))
    (tmp_path / "r0/other.json").write_text("{}")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/results.json").write_text("{")
    out = {r["name"]: r for r in reports.load_reports(reports.read_report_files(spark, str(tmp_path))).collect()}
    assert out.keys() == {"r0", "r1"}
    r = out["r0"]
    assert r["summary"] == {"bm25": {k: float(v) for k, v in quality.items()}} and r["indexing"]["r"]["skipped_files"] == 2
    assert "skipped" not in r["indexing"]["r"]["metrics"] and r["id"] == hashlib.sha256(b"r0/results.json").hexdigest()[:32]


def test_label_checks(spark):
    rel = [("p", 3, 2)]
    rows = [("q1", "r", "text", "dev", True, [("p", 1, 2)]), ("q1", "r", " ", "test", False, []), ("q2", "x", "t", "other", True, rel), ("q3", "r", "t", "test", True, [("p", 0, 2)])]
    labels = spark.createDataFrame(rows, "id string, repository string, query string, split string, human_confirmed boolean, relevant array<struct<path: string, start_line: int, end_line: int>>")
    found = {(r["violation"], r["subject"]) for r in evaluate.validate_labels(labels, spark.createDataFrame([("r",), ("r",)], "name string"), (3, 20, 5)).collect()}
    assert found == {("unique-repository", "r"), ("unique-query", "q1"), ("repository", "q2"), ("split", "q2"), ("text", "q1"), ("range", "q2"), ("range", "q3"), ("protocol", "r"), ("protocol", "x"), ("protocol", "repositories")}
    entries = spark.createDataFrame([("r", "s", "c1"), ("x", "t", "c2")], "name string, snapshot_id string, commit_sha string")
    shots = spark.createDataFrame([("s", "c1"), ("t", "other")], "id string, commit_sha string")
    assert {(r["violation"], r["subject"]) for r in evaluate.gates(labels, entries, shots).collect()} == {("unconfirmed", "q1"), ("commit", "x")}


def test_known_ranking(spark):
    ranked = spark.createDataFrame([(1, "s", n, c) for n, c in enumerate("xba", 1)] + [(2, "s", 1, "x")], "query_id long, strategy string, rank int, chunk_id string")
    relevant = spark.createDataFrame([(1, c) for c in "abc"] + [(2, "y")], "query_id long, chunk_id string")
    out = {r["query_id"]: r for r in evaluate.retrieval_metrics(ranked, relevant, "strategy").collect()}
    assert out[1]["recall_5"] == pytest.approx(2 / 3) and out[1]["mrr_10"] == 0.5 and out[2]["recall_20"] == out[2]["mrr_10"] == 0
    asked = spark.createDataFrame([(1,), (3,)], "query_id long")
    assert [r["query_id"] for r in evaluate.unlabelled(asked, relevant).collect()] == [3]


def test_latencies(spark):
    df = spark.createDataFrame([("s", float(x)) for x in range(1, 21)], "strategy string, latency_ms double")
    assert tuple(evaluate.latency_summary(df, "strategy").first()) == ("s", 10.5, 19.0)
