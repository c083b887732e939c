import hashlib
import itertools
import random
import re
import zlib

import pytest

from codelake.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos long, piece long, cost long"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def applied(rows, audit):
    """What the edits make of the rows, and their cost; None if they may not."""
    left, found, out, cost = list(rows), faults(rows), [], 0
    for letter in audit:
        wanted = "assistant" if out and out[-1][0][:1] == "u" else "user"
        cost += COST[letter]
        if letter == "I":
            out.append((wanted, ""))
            continue
        (role, text), fault = left.pop(0), found.pop(0)
        if letter == "D":
            continue
        if fault in ("b", "d"):
            return None
        cost += 5 * (fault == "t")
        out.append((role if letter == "K" else wanted, text))
    initials = "".join(role[:1] or "-" for role, _ in out)
    return (cost, audit, out) if not left and re.fullmatch("(s?(ua)+)?", initials) else None


def every_audit(n, inserts):
    for extra in range(inserts + 1):
        for places in itertools.combinations(range(n + extra), extra):
            for letters in itertools.product("DKR", repeat=n):
                rest = iter(letters)
                yield "".join("I" if i in places else next(rest) for i in range(n + extra))


def cheapest(rows):
    """By trying all edits with up to two insertions; a third costs more than deleting up to seven rows."""
    return min(filter(None, (applied(rows, a) for a in every_audit(len(rows), 2))))


def searched(rows):
    """Cheapest (cost, audit) for each text's end, row by row: for longer conversations."""
    best = {"": (0, "")}  # by what the initials leave open: nothing, s, u, a
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to, new = ("a" if state == "u" else "u"), (cost + 5, audit + "I")
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    best = inserted(best)
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, audit) in best.items():
            moves = [(state, cost + 2, "D")]
            if fault not in ("b", "d"):
                x = 5 * (fault == "t")
                if (state, role[:1]) in step:
                    moves.append((role[:1], cost + x, "K"))
                moves.append(("a" if state == "u" else "u", cost + x + 1, "R"))
            for to, c, letter in moves:
                if to not in after or (c, audit + letter) < after[to]:
                    after[to] = (c, audit + letter)
        best = inserted(after)
    return min(v for k, v in best.items() if k in ("", "a"))


def expected(rows, audit):
    text = "\n".join(f"{role}:{text}" for role, text in applied(rows, audit)[2])
    return hashlib.sha256(text.encode()).hexdigest()


def made(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", "User", "agent"], ["Yes.", "no", " ", "", "Why? ", "x", "é!", "a b\n", "."]
    return [(rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randrange(99)}.") for _ in range(n)]


def test_cheapest_edits_against_all_edits(spark):
    rng = random.Random(4)
    talks = {i: made(rng, rng.randrange(1, 5)) for i in range(60)}
    rows = [(i, t, role, text, "k", 1, 2, 3) for i, talk in talks.items() for t, (role, text) in enumerate(talk)]
    report, repaired = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), piece_rows=2)
    got = {r.key: (r.cost, r.audit) for r in report.collect()}
    digests = {r.key: r.sha256 for r in conversation_repair.digests(repaired).collect()}
    for i, talk in talks.items():
        cost, audit, _ = cheapest(talk)
        assert got[f"c{i}"] == (cost, audit) == searched(talk), talk
        assert digests.get(f"c{i}", hashlib.sha256(b"").hexdigest()) == expected(talk, audit)


@pytest.mark.parametrize("piece_rows", [1, 7, 256])
def test_long_conversations_in_pieces(spark, piece_rows):
    rng = random.Random(9)
    talks = {1: made(rng, 700), 2: made(rng, 90), 3: [("user", f"{i}.") for i in range(300)], 4: [("user" if i % 2 else "assistant", f"{i}!") for i in range(300)]}
    rows = [(i, t, role, text, "k", 1, 2, 3) for i, talk in talks.items() for t, (role, text) in enumerate(talk)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    report, repaired = conversation_repair.repair(df, piece_rows=piece_rows)
    digests = {r.key: r.sha256 for r in conversation_repair.digests(repaired).collect()}
    for r in report.collect():
        talk = talks[int(r.key[1:])]
        cost, audit = searched(talk)
        assert (r.cost, r.audit, digests[r.key]) == (cost, audit, expected(talk, audit))
        found = faults(talk)
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(found.count, "bdt"))
        initials = [role[:1] for role, _ in talk]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def test_costs_settle_in_few_passes(spark):
    talk = made(random.Random(2), 2000)
    df = spark.createDataFrame([(1, t, role, text, "k", 1, 2, 3) for t, (role, text) in enumerate(talk)], SCHEMA)
    pieces = conversation_repair._pieces(conversation_repair._numbered(conversation_repair.rows_of(df)), 64)
    _, passes = conversation_repair._settled(pieces, None)
    assert passes <= 8  # of 32 pieces: vectors forget soon where they come from


def test_odd_rows_and_damage(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 3, "assistant", "b."), (1, 3, "assistant", "b."), (None, 0, "user", "x."), (None, 1, "assistant", "y."), (2, None, "user", "lone."), (3, 0, "assistant", "w " * 100_000 + ".")]
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA)
    report, repaired = conversation_repair.repair(df)
    got = {r.key: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    assert got[""] == (0, 0, 0, 0, 0, 0, "KK")
    assert got["c2"] == (0, 0, 0, 0, 0, 2, "D") and got["c3"] == (0, 0, 0, 0, 0, 2, "D")
    assert got["c1"][:4] == (0, 1, 1, 0) and got["c1"][5] == 4 and sorted(got["c1"][6]) == list("DDKK")
    assert [(r.place, r.role, r.text) for r in repaired.where("key = 'c1'").collect()] == [(0, "user", "a."), (1, "assistant", "b.")]
    out = {r.conv_id: r for r in conversation_repair.damage_report(df).collect()}
    assert out.keys() == {None, 1, 2, 3}
    gone = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][0]
    lost = conversation_repair.damage_report(spark.createDataFrame([(gone, 0, "user", "x.", "k", 1, 2, 3)], SCHEMA)).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.damage_report(df.where("false")).count() == 0
