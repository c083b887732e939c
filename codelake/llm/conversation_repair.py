"""Repair of conversation structure by a parallel Viterbi search with rank convergence.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Keeping a row costs 0, giving it another
role 1, deleting it 2, inserting an empty user or assistant row 5; blank and duplicate rows must be
deleted, truncated ones that stay cost 5 more.  The cheapest edits win, of equally cheap ones those
whose initials (K, R, D, I) come first in ASCII order.

States are what has been emitted so far: nothing, s, u or a.  Rows are numbered in the order of all
conversations and cut into pieces of ``piece_rows``.  The cost to go of the four states is computed
backward inside every piece at once: the last piece of a conversation starts from the true costs at
its end, the others from a speculative vector of zeros.  Each fix-up pass takes over what the next
piece has found, and runs a piece again until its vector differs from that of the run before by a
constant alone; from there on back nothing changes.  When no piece's first vector changes, all are
right up to a constant, which no choice depends on.  Each piece is then traced forward from each
state that it may be entered in, taking the least letter that loses nothing; the states chosen are
stitched from piece to piece.

Scale: a long conversation is cut like all others: pieces hold row codes (one character a row), never
texts, and pass in parallel; a vector is found once for equal surroundings, so a row costs a look-up.
What one task takes of one conversation grows with it only where the result asks for it: its audit is
one cell, and its repaired rows come in order, streamed from one sorted partition (an SHA-256 of
them can't be put together from parts); neither is held whole with texts.

Edge cases: null roles and texts count as one space, null turns come first, null conversation ids are
one conversation; rows of equal turn are ordered by a hash of role and text, equal rows are kept apart
and are duplicates; empty roles and other initials must be changed or deleted; a conversation without
rows is cost 0 with an empty audit; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered

RETITLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
_SOUND, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_INITIALS = "sua"  # the fourth code stands for any other
_ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing emitted, 1 after s, 2 after u, 3 after a.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_WANTED = "uuau"
_AT_END = (0, 2 * INSERT, INSERT, 0)
_FREE = (0, 0, 0, 0)

Costs = tuple[int, int, int, int]


@functools.cache
def _step(code: str, after: Costs) -> tuple[Costs, tuple[tuple[str, int, int], ...]]:
    """Costs before a row from those after it, less their minimum; and for each state the least letters, the next state, and what they cost."""
    kind, fault = divmod(ord(code) - ord("A"), 4)
    extra = CUT_SHORT if fault == _TRUNCATED else 0
    own = []
    for s in range(4):
        options = [(DELETE + after[s], "D", s, DELETE)]
        if fault not in (_BLANK, _DUPLICATE):
            kept = _NEXT.get((_INITIALS[kind], s)) if kind < 3 else None
            if kept is not None:
                options.append((extra + after[kept], "K", kept, extra))
            other = _NEXT[_WANTED[s], s]
            options.append((RETITLE + extra + after[other], "R", other, RETITLE + extra))
        own.append(min(options))
    at_u, at_a = min(own[2][0], INSERT + own[3][0]), min(own[3][0], INSERT + own[2][0])
    before = (min(own[0][0], INSERT + at_u), min(own[1][0], INSERT + at_u), at_u, at_a)

    def move(s: int) -> tuple[str, int, int]:
        cost, letter, state, price = own[s]
        there = _NEXT[_WANTED[s], s]
        if INSERT + before[there] == before[s] and not (letter == "D" and cost == before[s]):
            letters, state, price = move(there)
            return "I" + letters, state, price + INSERT
        return letter, state, price

    least = min(before)
    return tuple(x - least for x in before), tuple(move(s) for s in range(4))


def _swept(codes: str, right: Costs) -> Costs:
    for code in reversed(codes):
        right = _step(code, right)[0]
    return right


def _fixed_up(codes: str, old: Costs, new: Costs, left: Costs) -> Costs:
    """The first vector with ``new`` behind the piece, given that ``old`` led to ``left``."""
    for code in reversed(codes):
        if old == new:
            return left
        old, new = _step(code, old)[0], _step(code, new)[0]
    return new


def _traced(codes: str, right: Costs, is_last: bool, entries: range) -> tuple[list, list, list]:
    """For each state of entry: letters, the state at the end, and costs."""
    moves = []
    for code in reversed(codes):
        right, own = _step(code, right)
        moves.append(own)
    letters, exits, costs = [], [], []
    for state in entries:
        found, cost = [], 0
        for own in reversed(moves):
            part, state, price = own[state]
            found.append(part)
            cost += price
        if is_last:  # what is still missing
            found.append("I" * (_AT_END[state] // INSERT))
            cost += _AT_END[state]
        letters.append("".join(found))
        exits.append(state)
        costs.append(cost)
    return letters, exits, costs


def _each(rows: DataFrame, f, schema: str) -> DataFrame:
    """Rows from a function of each row's values."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([f(*row) for row in frame.itertuples(index=False)], columns=names)

    return rows.mapInPandas(run, schema)


def key_of_id(conv: Column | str) -> Column:
    """Never null, and other for each id."""
    return F.coalesce(F.concat(F.lit("c"), (F.col(conv) if isinstance(conv, str) else conv).cast("string")), F.lit(""))


def rows_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key, turn, role, text and their hash."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(
        key_of_id(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(space(role_col)), space(role_col), space(text_col)), 256)).alias("digest"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows without texts, numbered in the order of conversation and turn, with code: initial and first fault."""
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, _INITIALS)), F.substring("role", 1, 1)), F.lit(0)).cast("int")
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select("key", "turn", "digest", F.when(initial > 0, initial - 1).otherwise(3).alias("kind"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    apart = F.pmod(F.monotonically_increasing_id(), F.lit(64))  # equal rows may be many: they needn't lie in one partition
    placed = numbered(materialise(narrow.withColumn("apart", apart), "turns"), "key", F.asc_nulls_first("turn"), "digest", "apart", label="turns")
    first = placed.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), _BLANK).when(F.col("first").isNull(), _DUPLICATE).when(F.col("open"), _TRUNCATED).otherwise(_SOUND)
    return materialise(placed.join(first, "pos", "left").select("pos", "key", "turn", "digest", "kind", fault.alias("fault")), "turns")


def _pieces(placed: DataFrame, piece_rows: int) -> DataFrame:
    """key, piece, codes, the place of their first row, whether the conversation begins or ends here, and the code that follows."""
    code = F.char(F.lit(ord("A")) + 4 * F.col("kind") + F.col("fault"))
    rows = placed.select("key", F.floor(F.col("pos") / piece_rows).alias("piece"), "pos", code.alias("code"), "turn", "digest")
    cut = rows.groupBy("key", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"),  # of piece_rows at most
        F.min_by(F.struct("turn", "digest"), "pos").alias("at"),
    )
    cut = materialise(cut, "pieces")
    ahead = cut.select("key", (F.col("piece") - 1).alias("piece"), F.substring("codes", 1, 1).alias("ahead"))
    behind = cut.select("key", (F.col("piece") + 1).alias("piece"), F.lit(True).alias("behind"))
    both = cut.join(ahead, ["key", "piece"], "left").join(behind, ["key", "piece"], "left")
    return materialise(both.select("key", "piece", "codes", "at", F.col("behind").isNull().alias("is_first"), F.col("ahead").isNull().alias("is_last"), "ahead"), "pieces")


def _settled(pieces: DataFrame, max_passes: int | None) -> tuple[DataFrame, int]:
    """key, piece and the costs behind each piece (of conversations of several pieces), right up to a constant; and the passes it took."""
    vectors = "key string, piece long, codes string, is_last boolean, right array<int>, left array<int>, changed boolean"

    def begin(key, piece, codes, is_last):
        right = _AT_END if is_last else _FREE
        return key, piece, codes, is_last, right, _swept(codes, right), True

    def again(key, piece, codes, is_last, right, left, wanted):
        right, left = tuple(map(int, right)), tuple(map(int, left))
        new = right if is_last else tuple(map(int, wanted))
        found = _fixed_up(codes, right, new, left)
        return key, piece, codes, is_last, new, found, found != left

    several = pieces.where("not (is_first and is_last)").select("key", "piece", "codes", "is_last")
    now, passes = materialise(_each(several, begin, vectors), "vectors"), 0
    while max_passes is None or passes < max_passes:
        ahead = now.select("key", (F.col("piece") - 1).alias("piece"), F.col("left").alias("wanted"))
        found = now.drop("changed").join(ahead, ["key", "piece"], "left")
        now, passes = materialise(_each(found.select("key", "piece", "codes", "is_last", "right", "left", "wanted"), again, vectors), "vectors"), passes + 1
        if now.where("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"costs did not settle in {max_passes} passes")
    return now.select("key", "piece", "right"), passes


def _letters(pieces: DataFrame, settled: DataFrame) -> DataFrame:
    """key, piece, at, letters and cost of the edits chosen."""

    def trace(key, piece, codes, is_first, is_last, right):
        costs = _AT_END if is_last else tuple(map(int, right))
        return key, piece, is_first and is_last, *_traced(codes, costs, is_last, range(1) if is_first else range(4))

    ready = pieces.join(settled, ["key", "piece"], "left").select("key", "piece", "codes", "is_first", "is_last", "right")
    traced = materialise(_each(ready, trace, "key string, piece long, alone boolean, letters array<string>, exits array<int>, costs array<long>"), "traces")

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:  # one row for each piece of a conversation
        rows, state, entries = rows.sort_values("piece"), 0, []
        for exits in rows["exits"]:
            entries.append(state)
            state = int(exits[state])
        return pd.DataFrame({"key": rows["key"], "piece": rows["piece"], "entry": entries})

    entries = traced.where("not alone").groupBy("key").applyInPandas(stitch, "key string, piece long, entry int")
    chosen = traced.join(entries, ["key", "piece"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    chosen = chosen.select("key", "piece", F.get("letters", "entry").alias("letters"), F.get("costs", "entry").alias("cost"))
    return materialise(chosen.join(pieces.select("key", "piece", "at"), ["key", "piece"]), "letters")


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired rows of the conversations of a sorted partition: letters come before the rows that they are for."""
    key, pending, at, state, place = None, "", 0, 0, 0

    def inserts(out: list) -> None:
        nonlocal at, state, place
        while pending[at : at + 1] == "I":
            initial = _WANTED[state]
            out.append((key, place, _ROLES[initial], ""))
            state, at, place = _NEXT[initial, state], at + 1, place + 1

    for frame in frames:
        out = []
        for own, letters, role, text in zip(frame["key"], frame["letters"], frame["role"], frame["text"], strict=True):
            if own != key:
                inserts(out)
                key, pending, at, state, place = own, "", 0, 0, 0
            if letters is not None:
                pending, at = pending[at:] + letters, 0
                continue
            inserts(out)
            letter, at = pending[at], at + 1
            if letter != "D":
                initial = role[:1] if letter == "K" else _WANTED[state]
                out.append((key, place, role if letter == "K" else _ROLES[initial], text))
                state, place = _NEXT[initial, state], place + 1
        yield pd.DataFrame(out, columns=["key", "place", "role", "text"])
    out = []
    inserts(out)
    yield pd.DataFrame(out, columns=["key", "place", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """key and the SHA-256 of its rows ``role:text``, joined by newlines; for rows as ``repair`` gives them, in order in their partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for frame in frames:
            done = []
            for own, role, text in zip(frame["key"], frame["role"], frame["text"], strict=True):
                if own != key:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pd.DataFrame(done, columns=["key", "sha256"])
        yield pd.DataFrame([(key, digest.hexdigest())] if digest else [], columns=["key", "sha256"])

    return repaired.mapInPandas(run, "key string, sha256 string")


def _report(placed: DataFrame, pieces: DataFrame, letters: DataFrame) -> DataFrame:
    faults = placed.groupBy("key").agg(*(F.count_if(F.col("fault") == n).alias(name) for name, n in (("blank", _BLANK), ("duplicate", _DUPLICATE), ("truncated", _TRUNCATED))))
    turns = placed.groupBy("key", "turn").agg(F.count("*").alias("n"))  # distinct turns, before they meet by conversation
    gaps = turns.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    # codes of four initials each: A to D is s, E to H is u, I to L is a
    joined = F.concat("codes", F.coalesce("ahead", F.lit("")))
    fine = F.regexp_count(joined, F.lit("[A-D](?=[E-H])|[E-H](?=[I-L])|[I-L](?=[E-H])"))
    illegal = pieces.groupBy("key").agg(F.sum(F.length(joined) - 1 - fine).alias("illegal"))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "letters"))), lambda x: x["letters"]), "")
    audits = letters.groupBy("key").agg(F.sum("cost").alias("cost"), in_order.alias("audit"))
    return gaps.join(faults, "key").join(illegal, "key").join(audits, "key")


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = 256, max_passes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A report (key, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation with rows, and the repaired rows (key, place, role, text).

    ``key`` is ``key_of_id`` of the conversation.  Repaired rows of one conversation lie in one partition and in order.
    """
    rows = rows_of(turns, conv_col, turn_col, role_col, text_col)
    placed = _numbered(rows)
    pieces = _pieces(placed, piece_rows)
    settled, _ = _settled(pieces, max_passes)
    letters = _letters(pieces, settled)
    orders = letters.select("key", F.col("at.turn").alias("turn"), F.col("at.digest").alias("digest"), F.lit(0).alias("is_row"), "piece", "letters", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("key", "turn", "digest", F.lit(1).alias("is_row"), F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("letters"), "role", "text")
    met = orders.unionByName(texts).repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "digest", "is_row", "piece")
    return _report(placed, pieces, letters), met.select("key", "letters", "role", "text").mapInPandas(_replay, "key string, place long, role string, text string")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of ``conv_id:turn``: of 20 rows one goes, one is emptied, one loses its sentence ends, one comes twice, one is the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    drawn = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damage_report(conversations: DataFrame, **options) -> DataFrame:
    """Every conversation's report after damage, with the hash of what repair makes of it."""
    report, repaired = repair(damage(conversations), **options)
    ids = conversations.select("conv_id").distinct().withColumn("key", key_of_id("conv_id"))
    found = ids.join(report, "key", "left").join(digests(repaired), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"))
