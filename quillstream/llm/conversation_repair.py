"""Repair of the structure of conversations: cheapest edits to an alternation of user and assistant, by Dial's bucket queue.

A conversation is accepted if its role initials are `(s?(ua)+)?`. Keeping a turn is free, giving it another role costs 3,
deleting it 4 (a must for blank and repeated turns), inserting an empty turn 3, and a truncated turn that stays 3 more. All
costs are small integers, so distances to the end are settled by a ring of buckets instead of a heap; the walk from the start
then takes the ASCII-least of the tight arcs, which gives the least of all cheapest audits (D, I, K, R).

Order of turns: by turn (null first), ties by role and text (their first 64 characters, then a digest of both). Nulls: a null
role or text is one space, a null conv_id is a conversation like any other. A role without a first letter s, u or a can't be
kept. Repeated rows are duplicates of the first. Extra columns are ignored. An empty table gives no row.

A conversation of up to `most_rows` turns and `most_chars` characters is repaired in one step of one task, so a task's memory is
bounded by them. A longer one is cut into blocks over many tasks: each block's distances from its end are a table of four by
four small numbers, blocks are chained by these tables, and each block is then walked alone. Its turns are gathered again only
to be hashed, in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions
from .streams import through

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States after a prefix of the accepted initials: nothing yet, s, u, a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that an edit puts in, and the states it is put in from.
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE: tuple[tuple[int, ...], ...] = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Longer than the dearest arc and than any difference between the distances of a block's last states.
RING = 32
FAR = 1 << 60
SOUND, BLANK, DUPLICATE, CUT = range(4)


class Turn(NamedTuple):
    """A turn's state if kept (0: none) and its first fault."""

    state: int
    fault: int


def distances(turns: list[Turn], ends: tuple[int, ...]) -> list[list[int]]:
    """For each place among the turns and each state, the cost of the cheapest way to the end, whose states cost `ends`.

    Dial's algorithm on the reversed arcs: nodes wait in a ring of buckets by distance, each settled once.
    """
    n = len(turns)
    far = [[FAR] * 4 for _ in range(n + 1)]
    ring: list[list[tuple[int, int, int]]] = [[] for _ in range(RING)]
    now, waiting = min(ends), 0

    def reach(i: int, state: int, d: int) -> int:
        if d < far[i][state]:
            far[i][state] = d
            ring[d % RING].append((d, i, state))
            return 1
        return 0

    for state, d in enumerate(ends):
        if d < FAR:
            waiting += reach(n, state, d)
    while waiting:
        bucket = ring[now % RING]
        if not bucket:
            now += 1
            continue
        d, i, state = bucket.pop()
        waiting -= 1
        if far[i][state] < d:
            continue
        for p in BEFORE[state]:
            waiting += reach(i, p, d + INSERT)
        if i:
            turn = turns[i - 1]
            waiting += reach(i - 1, state, d + DELETE)
            if turn.fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if turn.fault == CUT else 0
                for p in BEFORE[state]:
                    waiting += reach(i - 1, p, d + REROLE + more)
                if turn.state == state:
                    for p in (START,) if state == SYSTEM else BEFORE[state]:
                        waiting += reach(i - 1, p, d + KEEP + more)
    return far


def walk(turns: list[Turn], far: list[list[int]], ends: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least audit of all cheapest ones from a state, and the state it ends in. Letters in order: D, I, K, R."""
    i, n, out = 0, len(turns), []
    while True:
        here = far[i][state]
        if i == n and ends[state] == here:
            return "".join(out), state
        turn = turns[i] if i < n else None
        if turn and far[i + 1][state] + DELETE == here:
            out.append("D")
            i += 1
            continue
        if far[i][NEXT[state]] + INSERT == here:
            out.append("I")
            state = NEXT[state]
            continue
        more = TRUNCATED if turn.fault == CUT else 0
        if turn.state and (turn.state == SYSTEM and state == START or turn.state == NEXT[state]) and far[i + 1][turn.state] + KEEP + more == here:
            out.append("K")
            state = turn.state
        else:
            out.append("R")
            state = NEXT[state]
        i += 1


ACCEPTED = (0, FAR, FAR, 0)


def edits(audit: str, turns: list[Turn], state: int = START) -> Iterator[tuple[str, int, int]]:
    """(letter, place of the turn it is about, state after it) of an audit's edits."""
    i = 0
    for letter in audit:
        state = turns[i].state if letter == "K" else state if letter == "D" else NEXT[state]
        yield letter, i, state
        i += letter != "I"


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone and the columns that order and judge a turn. `gone` rows stand for conversations alone."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    return out.withColumns({"r64": F.substring("role", 1, 64), "t64": F.substring("text", 1, 64), "digest": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))})


#: Nulls come first.
ORDER = ("turn", "r64", "t64", "digest")
#: White space is these six alone.
WORD = r"[^\x20\x09-\x0D]"


def faults_of(text: Column) -> Column:
    """The fault that a text shows by itself."""
    return F.when(~text.rlike(WORD), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)


def _state(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)


LEGAL = {"su", "ua", "au"}


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _repair_one(rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """The summary of a conversation's rows (turn, role, text, fault) in order, and its repaired turns (edit, role, text)."""
    seen, turns, count = set(), [], [0, 0, 0, 0]
    for _, role, text, fault in rows:
        if fault != BLANK:
            if (role, text) in seen:
                fault = DUPLICATE
            else:
                seen.add((role, text))
        count[fault] += 1
        turns.append(Turn(STATES.get(role[:1], 0), fault))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    far = distances(turns, ACCEPTED)
    audit, _ = walk(turns, far, ACCEPTED, START)
    out = []
    for letter, i, state in edits(audit, turns):
        if letter != "D":
            out.append((letter, rows[i][1] if letter == "K" else ROLES[state], "" if letter == "I" else rows[i][2]))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in out).encode()).hexdigest()
    return (gaps, count[BLANK], count[DUPLICATE], count[CUT], illegal, far[0][START], audit, digest), out


def _whole(rows: Iterator[tuple], with_turns: bool) -> Iterator[tuple]:
    """The summary of each conversation of rows sorted by it, or its repaired turns."""

    def conversations() -> Iterator[tuple]:
        held, last = [], ()
        for conv, gone, *row in rows:
            if last and last[0] != conv:
                yield last[0], held
                held = []
            last = (conv,)
            if not gone:
                held.append(tuple(row))
        if last:
            yield last[0], held

    for conv, own in conversations():
        summary, turns = _repair_one(own)
        if with_turns:
            yield from ((conv, k, *turn) for k, turn in enumerate(turns))
        else:
            yield conv, *summary


BLOCK = """conv string, conv_id long, part long, block long, codes binary, digests binary, n long, blank long, duplicate long, truncated long, illegal long,
    first_initial string, last_initial string, first_turn long, last_turn long, turns long"""


def _blocks(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Blocks of a partition's sorted rows (conv, conv_id, turn, initial, state, fault, digest, first): a byte and a digest a turn."""
    part = TaskContext.get().partitionId()
    block, before, held = 0, None, []

    def closed() -> tuple:
        counts = [sum(r[5] == k for r in held) for k in (BLANK, DUPLICATE, CUT)]
        illegal = sum(a[3] + b[3] not in LEGAL for a, b in zip(held, held[1:], strict=False))
        turns = len({r[2] for r in held if r[2] is not None})
        codes, digests = bytes(r[4] << 2 | r[5] for r in held), b"".join(r[6] for r in held)
        return held[0][0], held[0][1], part, block, codes, digests, len(held), *counts, illegal, held[0][3], held[-1][3], held[0][2], held[-1][2], turns

    for conv, conv_id, turn, initial, state, fault, digest, first in rows:
        if held and (held[0][0] != conv or len(held) >= most):
            yield closed()
            block, held = block + 1, []
        # `first`, of texts that occur more than once: 0 in a later turn, else 1; of those of one turn the first stays
        if fault != BLANK and first is not None and (not first or before == (conv, digest)):
            fault = DUPLICATE
        before = (conv, digest)
        held.append((conv, conv_id, turn, initial, state, fault, digest))
    if held:
        yield closed()


def _turns(codes: bytes) -> list[Turn]:
    return [Turn(c >> 2, c & 3) for c in codes]


def _tables(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each block's cost from every state at its start to every state at its end, as sixteen numbers."""
    for conv, part, block, codes in rows:
        turns = _turns(codes)
        columns = [distances(turns, tuple(0 if k == q else FAR for k in range(4)))[0] for q in range(4)]
        yield conv, part, block, [columns[q][p] for p in range(4) for q in range(4)]


def _ends(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What each state costs at a block's end, for blocks that come last first."""
    last, ends = None, ACCEPTED
    for conv, part, block, table in rows:
        if conv != last:
            last, ends = conv, tuple(min(d, min(ACCEPTED[NEXT[k]] + INSERT, FAR)) for k, d in enumerate(ACCEPTED))
        yield conv, part, block, list(ends)
        ends = tuple(min(min(table[4 * p + q] + ends[q] for q in range(4)), FAR) for p in range(4))


def _exits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state in which the walk through a block ends, for each state in which it may begin."""
    for conv, part, block, codes, ends in rows:
        turns = _turns(codes)
        far = distances(turns, tuple(ends))
        yield conv, part, block, [walk(turns, far, tuple(ends), p)[1] if far[0][p] < FAR else p for p in range(4)]


def _entries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The state in which the walk enters each block, for blocks in order, and what adjacent blocks add to counts."""
    last, state, turn, initial = None, START, None, None
    for conv, part, block, exits, first_initial, last_initial, first_turn, last_turn in rows:
        if conv != last:
            last, state, turn, initial = conv, START, None, None
        bad = initial is not None and initial + first_initial not in LEGAL
        yield conv, part, block, state, int(bad), int(turn is not None and turn == first_turn)
        state, turn, initial = exits[state], last_turn, last_initial


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The edits of each block in order: letter, role of what is inserted or gets another, digest of the turn it is about."""
    for conv, part, block, codes, digests, ends, state, final in rows:
        turns = _turns(codes)
        stop = ACCEPTED if final else tuple(ends)
        audit, _ = walk(turns, distances(turns, stop), stop, state)
        for k, (letter, i, after) in enumerate(edits(audit, turns, state)):
            fault = turns[i].fault if letter in "KR" else SOUND
            cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (TRUNCATED if fault == CUT else 0)
            yield conv, part, block, k, letter, ROLES[after] if letter in "IR" else None, digests[16 * i : 16 * i + 16] if letter in "KR" else None, cost


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Audit, cost and hash of each conversation's edits in order; one turn is held at a time, and a letter an edit."""
    last, sha, audit, total, some = None, None, [], 0, False
    for conv, letter, cost, role, text in rows:
        if conv != last:
            if last is not None:
                yield last, total, "".join(audit), sha.hexdigest()
            last, sha, audit, total, some = conv, hashlib.sha256(), [], 0, False
        audit.append(letter)
        total += cost
        if letter != "D":
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
    if last is not None:
        yield last, total, "".join(audit), sha.hexdigest()


def _long(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of long conversations with what adjacent ones add, and their edits with roles and texts."""
    rows = rows.filter(~F.col("gone")).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    place = F.struct("turn")  # a struct puts a null turn first
    again = rows.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).filter("n > 1").select("conv", "digest", "earliest")
    narrow = rows.select("conv", "conv_id", "turn", "r64", "t64", F.substring("role", 1, 1).alias("initial"), _state(F.col("role")).alias("state"), faults_of(F.col("text")).alias("fault"), "digest")
    narrow = narrow.join(again, ["conv", "digest"], "left").withColumn("first", (place == F.col("earliest")).cast("int"))
    dealt = narrow.repartitionByRange(partitions(rows.sparkSession), "conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    dealt = dealt.select("conv", "conv_id", "turn", "initial", "state", "fault", "digest", "first")
    blocks = materialise(through(dealt, lambda b: _blocks(b, block), BLOCK, lambda row: 200 + 17 * row[6]), "blocks")
    at = ["conv", "part", "block"]
    keys = "conv string, part long, block long"
    tables = through(blocks.select(*at, "codes"), _tables, f"{keys}, costs array<long>")
    ends = through(tables.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block")), _ends, f"{keys}, ends array<long>")
    ends = materialise(ends, "ends")
    exits = through(blocks.join(ends, at).select(*at, "codes", "ends"), _exits, f"{keys}, exits array<int>")
    ordered = exits.join(blocks.select(*at, "first_initial", "last_initial", "first_turn", "last_turn"), at).repartition("conv").sortWithinPartitions(*at)
    entries = materialise(through(ordered, _entries, f"{keys}, state int, more_illegal long, shared_turn long"), "entries")
    final = blocks.groupBy("conv").agg(F.max(F.struct("part", "block")).alias("last"))
    walked = blocks.join(ends, at).join(entries, at).join(final, "conv").select(*at, "codes", "digests", "ends", "state", (F.struct("part", "block") == F.col("last")).alias("final"))
    done = through(walked, _edits, f"{keys}, k long, edit string, role string, digest binary, cost long")
    texts = rows.groupBy("conv", "digest").agg(F.first("role").alias("own"), F.first("text").alias("own_text"))
    done = done.join(texts, ["conv", "digest"], "left").select(*at, "k", "edit", "cost", F.coalesce("role", "own").alias("role"), F.coalesce("own_text", F.lit("")).alias("text"))
    return blocks.join(entries, at), done


def _split(turns: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that one step takes, and those of longer ones, if there are any."""
    rows = _ordered(turns)
    sizes = rows.filter(~F.col("gone")).groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.length("text") + F.length("role")).alias("chars"))
    long = materialise(sizes.filter((F.col("rows") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("long_id")), "long")
    if long.isEmpty():
        return rows, None
    same = rows["conv_id"].eqNullSafe(long["long_id"])
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def _in_one_step(rows: DataFrame, with_turns: bool) -> DataFrame:
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    given = dealt.select("conv_id", "gone", "turn", "role", "text", faults_of(F.col("text")).alias("fault"))
    if with_turns:
        return through(given, lambda r: _whole(r, True), REPAIRED, lambda row: 100 + len(row[-1]))
    return through(given, lambda r: _whole(r, False), SUMMARY, lambda row: 100 + len(row[7]))


def repair(turns: DataFrame, most_rows: int = 50_000, most_chars: int = 32_000_000, block: int = 50_000) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text[, gone]): faults, cost, audit, hash of the repaired turns.

    gaps are numbers missing between the least and the greatest turn; blank, duplicate and truncated count turns by their first
    fault, illegal adjacent role initials other than su, ua, au. A row that is `gone` stands for its conversation alone, so one
    with no other row gives zeros, an empty audit and the hash of nothing.
    """
    short, long = _split(turns, most_rows, most_chars)
    found = _in_one_step(short, False)
    if long is None:
        return found
    blocks, done = _long(long, block)
    stream = done.repartition("conv").sortWithinPartitions("conv", "part", "block", "k").select("conv", "edit", "cost", "role", "text")
    hashed = through(stream, _hashed, "conv string, cost long, audit string, repaired_sha256 string", lambda row: 100 + len(row[2]))
    count = lambda c: F.sum(c).alias(c)
    numbers = F.coalesce(F.max("last_turn") - F.min(F.when(F.col("turns") > 0, F.col("least"))) + 1 - F.sum(F.col("turns") - F.col("shared_turn")), F.lit(0).cast("long"))
    least = long.filter(~F.col("gone")).groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).agg(F.min("turn").alias("least"))
    totals = blocks.join(least, "conv").groupBy("conv").agg(F.first("conv_id").alias("conv_id"), numbers.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), (F.sum("illegal") + F.sum("more_illegal")).alias("illegal"))
    return found.unionByName(totals.join(hashed, "conv", "left").select(*[c.split()[0] for c in SUMMARY.split(", ")]))


def repaired_turns(turns: DataFrame, most_rows: int = 50_000, most_chars: int = 32_000_000, block: int = 50_000) -> DataFrame:
    """The turns of the repaired conversations: (conv_id, place, edit, role, text); places ascend, and have gaps in long ones."""
    short, long = _split(turns, most_rows, most_chars)
    found = _in_one_step(short, True)
    if long is None:
        return found
    _, done = _long(long, block)
    place = F.col("part") * (1 << 42) + F.col("block") * (1 << 21) + F.col("k")
    return found.unionByName(done.filter("edit <> 'D'").select(F.expr("CAST(nullif(conv, '') AS long)").alias("conv_id"), place.alias("place"), "edit", "role", "text"))


def damage(turns: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of `conv_id:turn` modulo 20: 0 is gone, 1 loses its text, 2 its `[.!?]`, 3 comes twice, 4 is a user's.

    A null of any column is one space in the key, the role and the text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")
