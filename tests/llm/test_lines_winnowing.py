import hashlib
import random
import re

import duckdb
import pytest

from codelake.llm import line_dedup, winnowing
from codelake.llm.queries import ORACLES

from .conftest import LONG


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def brute_removed(rows, least=16):
    """By row: ids (null ones last), then texts' hashes, then lines; equal rows have the same place."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    texts = SparkSession.getActiveSession().createDataFrame([(t,) for _, t, _ in rows], "t string")
    hashed = {r["t"]: r["h"] for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}
    key = lambda d, t: (d is None, d or 0, hashed[t])
    first = {}
    for d, text in sorted(((d, t) for d, t, _ in rows), key=lambda r: key(*r)):
        for i, line in enumerate(text.split("\n")):
            if len(line) >= least:
                first.setdefault(line, (key(d, text), i))
    gone = {}
    for d, text, _ in rows:
        for i, line in enumerate(text.split("\n")):
            if line in first:
                near = any(abs(len(o) - len(line)) <= 1 and o != line and first[o] < first[line] and within_one(o, line) for o in first)
                if near or first[line] != (key(d, text), i):
                    gone.setdefault((d, text), set()).add(i)
    return gone


def edited(rng, line):
    i, c = rng.randrange(len(line)), rng.choice("abé ")
    return rng.choice([line[:i] + c + line[i:], line[:i] + line[i + 1 :], line[:i] + c + line[i + 1 :], line[: i // 2] + c + line[i // 2 + 1 : i] + c + line[i:]])


def lines_corpus(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.choice([3, 15, 16, 17, 40, 90, 300]))) for _ in range(40)] + ["a" * 30, "a" * 31, "a" * 32, "x" * 1000, "x" * 1001]
    rows = []
    for d in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.6 else edited(rng, rng.choice(pool)) for _ in range(rng.randrange(1, 7))]
        rows.append((d * 3, "\n".join([*lines, "the hot line that everyone has"] if d % 3 == 0 else lines), "s"))
    return rows


def check_lines(docs_of, rows):
    want = brute_removed(rows)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.without_repeated_lines(docs_of(rows)).collect())
    assert texts == sorted((str(d), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get((d, t), ()))) for d, t, _ in rows)
    counts = sorted((str(r["doc_id"]), r["n_lines"], r["equal_lines"] + r["near_lines"]) for r in line_dedup.line_report(docs_of(rows)).collect())
    assert counts == sorted((str(d), t.count("\n") + 1, len(want.get((d, t), ()))) for d, t, _ in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(docs_of, seed):
    check_lines(docs_of, lines_corpus(seed))


def test_null_and_repeated_ids(docs_of):
    """Rows of one id keep their own lines; rows without id take part; equal rows count as one."""
    line, near = "a line that stands in some places", "a line that stands in some placeS"
    rows = [(1, line), (5, f"a line that is unique A\n{line}"), (5, f"{line}\nthis line is unique, B"), (None, f"null one\n{line}"), (None, f"{near}\nsomething of its own"), (7, near), (7, near)]
    check_lines(docs_of, [(i, t, "s") for i, t in rows])


def test_long_lines(docs_of):
    """Lines of 1,000 to 60,000 characters, one character apart, wherever it stands."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (1000, 1023, 1024, 1025, 1281, 5000, 60_000)]
    rows = [(i, b, "s") for i, b in enumerate(base)]
    for n, b in enumerate(base):
        for k, at in enumerate((0, 1, len(b) // 4, len(b) // 2 + 1, len(b) - 1)):
            rows += [(100 + 30 * n + k, b[:at] + "X" + b[at + 1 :], "s"), (110 + 30 * n + k, b[:at] + "Y" + b[at:], "s"), (120 + 30 * n + k, b[:at] + b[at + 1 :], "s")]
        rows.append((1000 + n, b[:200] + "ZZ" + b[202:], "s"))
    check_lines(docs_of, rows)
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs_of(rows)).collect()}
    assert all(not left[100 + 30 * n + k] for n in range(len(base)) for k in range(5)) and all(left[1000 + n] for n in range(len(base)))


def test_frames_of_pieces(docs_of, monkeypatch):
    """No step that Spark interprets cuts pieces out of whole lines, which cost three quarters of the first stage's CPU time."""
    plans = {}
    monkeypatch.setattr(line_dedup, "materialise", lambda df, label, store=line_dedup.materialise: plans.setdefault(label, df) and store(df, label))
    line_dedup.line_report(docs_of([(1, "a line of some length\n" + "x" * 3000, "s")]))
    plan = plans["distinct-lines"]._jdf.queryExecution().optimizedPlan().toString()
    assert "frames" in plan
    for found in re.finditer(r"lambdafunction\(", plan):
        depth, end = 1, found.end()
        while depth and end < len(plan):
            depth, end = depth + (plan[end] == "(") - (plan[end] == ")"), end + 1
        assert "substring(" not in plan[found.end() : end]


def test_frames_at_every_place(docs_of):
    """One character less, more or another, of one byte or more, at every place of lines of 16 to 21 characters and around the ends of parts of 1,020 to 1,028."""
    rng = random.Random(8)
    rows = []
    for n in (*range(16, 22), *range(1020, 1029)):
        base = "".join(rng.choice("abcdefgh") for _ in range(n))
        places = range(n) if n < 100 else sorted({0, n - 1, *(n * k // 4 + d for k in (1, 2, 3) for d in (-2, -1, 0, 1, 2)), *(256 * k + d for k in (1, 2, 3, 4) for d in (-1, 0, 1) if 256 * k + d < n)})
        for at in places:
            for text in (base[:at] + "\u00e9" + base[at + 1 :], base[:at] + "\U0001d4b3" + base[at:], base[:at] + base[at + 1 :], base[:at] + "Z" + base[at + 1 :]):
                rows.append((1000 + len(rows), text, "s"))
        rows.append((n, base, "s"))
    gone = {r["doc_id"]: r["near_lines"] for r in line_dedup.line_report(docs_of(rows), min_chars=15).collect() if r["near_lines"] or r["equal_lines"]}
    assert all(d in gone for d, _, _ in rows if d > 1028)
    check_lines(docs_of, [r for r in rows if len(r[1]) < 100])


def test_lines_report_matches_sql(docs_of):
    docs = docs_of([(d, t.replace("é", "e"), s) for d, t, s in lines_corpus(3)])
    documents = docs.toPandas()  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql("SELECT doc_id, n_lines, equal_lines, near_lines, kept_lines FROM (" + ORACLES["op7_line_dedup"] + ")").fetchall()}
    assert {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_report(docs).collect()} == want


def test_lines_odd_rows(odd, none, docs_of):
    odd = odd.withColumnsRenamed({"h": "gone", "role": "lines", "fp": "cut", "first": "row"})
    out = {(r["doc_id"], r["n_lines"]): r["kept_lines"] for r in line_dedup.line_report(odd).collect()}
    assert out[1, 0] == 0 and out[2, 1] == 1 and out[5, 1] == 1 and out[6, 1] == 1 and out[7, 1] == 0
    kept = line_dedup.without_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == 12
    assert [r["text"] for r in kept.where("doc_id = 1 or doc_id = 7").orderBy("doc_id").collect()] == [None, "", ""]
    assert line_dedup.line_report(none).count() == 0


def brute_words(text):
    """Runs of letters and digits, or single characters; the front of a run over 24 characters is single characters."""
    letter = lambda c: c.isascii() and c.isalnum() or "\u00aa" <= c <= "\u02ff" or "\u0370" <= c <= "\u0dff"
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and letter(text[j]):
            j += 1
        if j > i:
            out += [*text[i : max(i, j - 24)], text[max(i, j - 24) : j]]
        elif text[i] not in " \t\n\v\f\r":
            out.append(text[i])
            j = i + 1
        else:
            j = i + 1
        i = j
    return out


def brute_fingerprint(text, k=5, window=8):
    """Chosen positions by the textbook rule, over the library's own hashes of k words."""
    words = brute_words(text or "")
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    return words, grams, window


@pytest.mark.parametrize(("k", "width"), [(5, 8), (3, 5), (1, 1)])
def test_winnowing_rule(spark, docs_of, k, width):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 3, 4, 5, 9, 11, 12, 13, 40, 200, 200)] + ["don't, x" * 20, "日本語" * 30, "z" * 60]
    df = winnowing.with_fingerprint(docs_of([(i, t, "s") for i, t in enumerate(texts)]), "text", "chosen", k, width)
    rows = {r["doc_id"]: r for r in df.select("doc_id", "chosen", winnowing.hashes("chosen").alias("hs"), winnowing.positions("chosen").alias("ps")).collect()}
    seen = {}
    for i, text in enumerate(texts):
        _, grams, window = brute_fingerprint(text, k, width)
        chosen = {p: v >> winnowing.POSITION_BITS for v, p in zip(rows[i]["chosen"], rows[i]["ps"])}
        for p, h in chosen.items():  # equal grams have equal hashes
            assert seen.setdefault(grams[p], h) == h
        assert bool(chosen) == bool(grams)
        for a in range(max(1, len(grams) - window + 1)) if grams else ():
            inside = [p for p in chosen if a <= p < a + window]
            assert inside  # every window has a choice
            if all(g in seen for g in grams[a : a + window]):
                values = [seen[g] for g in grams[a : a + window]]
                assert a + max(j for j, v in enumerate(values) if v == min(values)) in chosen
    assert rows[10]["hs"] and len(set(rows[10]["hs"])) == len(rows[10]["hs"])


def test_common_passages_are_found(docs_of):
    rng = random.Random(9)
    w = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared = w(12)  # window + k - 1 words
    df = docs_of([(1, " ".join([*w(50), *shared, *w(60)]), "s"), (2, " ".join([*w(7), *shared]), "s"), (3, " ".join(w(100)), "s")])
    out = {r["doc_id"]: set(r["hs"]) for r in winnowing.with_fingerprint(df, "text", "c").select("doc_id", winnowing.hashes("c").alias("hs")).collect()}
    assert out[1] & out[2] and not out[1] & out[3]


def test_text_without_spaces_falls_in_step(docs_of):
    """400 characters of Chinese, and the same behind one more: nearly all hashes are shared; so for a run of letters."""
    rng = random.Random(3)
    for text in ("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)), "".join(rng.choice("abcdefgh") for _ in range(400))):
        df = docs_of([(1, text, "s"), (2, "x" + text, "s")])
        a, b = (set(r["hs"]) for r in winnowing.with_fingerprint(df, "text", "c").select("doc_id", winnowing.hashes("c").alias("hs")).orderBy("doc_id").collect())
        assert len(a & b) >= 0.9 * len(a | b)


def test_likeness_against_brute_force(docs_of):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 120))) for _ in range(25)]
    docs = docs_of([(i, t, "s") for i, t in enumerate(texts)])
    sets = lambda ts: {r["doc_id"]: set(r["hs"]) for r in winnowing.with_fingerprint(docs_of([(i, t, "s") for i, t in enumerate(ts)]), "text", "c").select("doc_id", winnowing.hashes("c").alias("hs")).collect()}
    edited = [t[: len(t) - len(t) // 2] + texts[i - 1][: len(t) // 2] for i, t in enumerate(texts)]
    own, other = sets(texts), sets(edited)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in winnowing.compare_with_edits(docs).collect():
        i = r["doc_id"]
        assert r["next_id"] == (i - 1) % 25
        assert abs(r["near_edited"] - like(own[i], other[i])) < 1e-12 and abs(r["near_next"] - like(own[i], own[(i - 1) % 25])) < 1e-12


def test_many_rows_without_id(docs_of):
    rows = [(None, f"text {i} of no id", "s") for i in range(600)] + [(2**60 * (i % 4) + i, f"text {i}", "s") for i in range(300)]
    out = winnowing.compare_with_edits(docs_of(rows)).collect()
    ids = sorted(r["doc_id"] for r in out if r["doc_id"] is not None)
    assert len(out) == 900 and sorted(r["next_id"] for r in out if r["next_id"] is not None) == ids
    before = {r["doc_id"]: r["next_id"] for r in out if r["doc_id"] is not None}
    assert all(before[b] == a for a, b in zip(ids, ids[1:])) and before[ids[0]] is None


def edited_sha(rows):
    ordered = sorted(rows, key=lambda r: (-(1 << 62) if r[0] is None else r[0]), reverse=True)
    want = {}
    for i, (d, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want[d] = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    return want


def test_neighbours_and_edits(docs_of):
    rng = random.Random(8)
    ids = rng.sample(range(3000), 150) + [10**7, 10**7 + 1, -5, 2 * 10**8]
    rows = [(i, " ".join(f"u{rng.randrange(5000)}é" for _ in range(rng.randrange(0, 80))), "s") for i in ids]
    out = {r["doc_id"]: r for r in winnowing.compare_with_edits(docs_of(rows, 5)).collect()}
    assert {d: r["edited_sha256"] for d, r in out.items()} == edited_sha(rows)
    assert {d: r["n_chars"] for d, r in out.items()} == {d: len(t) for d, t, _ in rows}
    long = [r for r in out.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.25 and max(r["near_next"] for r in long) < 0.2


def test_winnowing_odd_rows(odd, none, docs_of):
    out = winnowing.compare_with_edits(odd).collect()
    assert len(out) == 12 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    same = {r["fingerprint"] for r in out if r["doc_id"] in (6, 7)}
    assert len(same) == 1
    assert winnowing.compare_with_edits(none).count() == 0
    one = winnowing.compare_with_edits(docs_of([(3, "a b c d e f g h", "s")])).first()
    assert one["near_next"] == 1.0
