"""Repair, prefix trie of conversations and exact top-k against brute force, with nulls, repeats, ties, empties and long ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.llm import conversation_repair as R
from quillstream.llm import prefix_trie as P
from quillstream.llm import top_k as T

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def made_up(seed: int, convs: int, most: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["yes", "no", "why?", "ok.", "fine!", "", " \t", "end. ", "\x1c", "ça", None]
    rows = []
    for c in range(convs):
        for t in range(r.randrange(most + 1)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            rows.append((c if c else None, t if r.random() < 0.8 else r.choice([None, t + 3]), role, r.choice(words) if r.random() < 0.4 else f"{r.choice(words)} {r.randrange(99)}{r.choice('.!?,')}"))
    return rows + rows[: len(rows) // 10]


def damaged(rows: list[tuple]) -> dict:
    """Rows of each conversation after damage, in order."""
    out = defaultdict(list)
    space = lambda x: " " if x is None else str(x)
    for c, t, role, text in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        out[c] += []
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def brute_repair(rows: list[tuple]) -> tuple:
    """Cheapest (cost, audit) from each row and prefix state on, by a fixed point over insertions; no queue, no distances."""
    seen, faults = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(len(rows), -1, -1):
        now = dict(best) if i == len(rows) else {}
        if i < len(rows):
            _, role, text = rows[i]
            more = 3 * (faults[i] == "truncated")
            for p in ("", "s", "u", "a"):
                ways = [(4 + best[p][0], "D" + best[p][1], best[p][2])] if p in best else []
                if faults[i] not in ("blank", "duplicate"):
                    for to, name in (("u", "user"), ("a", "assistant")):
                        if (p, to) in step and to in best:
                            ways.append((3 + more + best[to][0], "R" + best[to][1], (f"{name}:{text}", *best[to][2])))
                    to = step.get((p, role[:1]))
                    if to and to in best:
                        ways.append((more + best[to][0], "K" + best[to][1], (f"{role}:{text}", *best[to][2])))
                if ways:
                    now[p] = min(ways)
        for _ in range(4):
            for (p, to), name in {k: {"u": "user", "a": "assistant"}.get(v) for k, v in step.items()}.items():
                if name and to in now:
                    way = (3 + now[to][0], "I" + now[to][1], (f"{name}:", *now[to][2]))
                    now[p] = min(now.get(p, way), way)
        best = now
    cost, audit, turns = best[""]
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = Counter(faults)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


@pytest.mark.parametrize("limits", [{}, {"most_rows": 3, "block": 2}, {"most_chars": 1, "block": 1}, {"most_rows": 20, "block": 7}])
def test_repair(spark, limits):
    rows = made_up(3, 60, 9) + [(500, 0, "user", "x.")] * 3 + [(501, None, "assistant", None)] + [(502, k % 40, random.Random(k).choice(["user", "assistant"]), f"t{k % 50}{'.' if k % 3 else ''}") for k in range(90)]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"state": F.lit("clash"), "part": F.lit(1), "digest": F.lit(2)})
    expected = {c: brute_repair(x) for c, x in damaged(rows).items()}
    found = {r[0]: tuple(r)[1:] for r in R.repair(R.damage(turns), **limits).collect()}
    assert found == expected
    text = defaultdict(list)
    for r in R.repaired_turns(R.damage(turns), **limits).orderBy("conv_id", "place").collect():
        text[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(text[c]).encode()).hexdigest() for c in expected} == {c: x[-1] for c, x in expected.items()}


def test_repair_of_nothing(spark):
    assert R.repair(R.damage(spark.createDataFrame([], TURNS))).count() == 0
    gone = next(k for k in range(200) if zlib.crc32(f"7:{k}".encode()) % 20 == 0)
    found = R.repair(R.damage(spark.createDataFrame([(7, gone, "user", "x")], TURNS))).collect()
    assert [tuple(r) for r in found] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


VECTORS = "vec_id long, embedding array<double>, label int"


def brute_top(rows: list[tuple], k: int) -> list[tuple]:
    ints = [(i, [int(64 * x // 1) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = set()
    for i, v in ints:
        if i is not None and i % 20 == 0:
            others = [(j, w) for j, w in ints if len(w) == len(v)]
            others.remove((i, v))
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for j, w in others)
            out |= {(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:k], 1)}
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1.0, 3000.0, 3e6])
def test_top_k(spark, size):
    r = random.Random(5)
    rows = [(i, [r.uniform(-size, size) for _ in range(6)], 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)] + [rows[20], rows[21], rows[40], (60, rows[3][1], 0), (None, rows[9][1], 2)]
    rows += [(2000, None, 0), (2020, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (2040, [float("nan")] * 6, 0), (2060, [float("inf")] * 6, 0), (2080, [1.0, 2.0], 0), (2081, [2.0, 1.0], 0), (2100, [], 0), (2120, [5.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"q": F.lit(1), "vector": F.lit("clash"), "own": F.lit(True)})
    for k in (20, 1, 400):
        found = T.top_k(frame, F.col("vec_id") % 20 == 0, k).collect()
        assert sorted(map(tuple, found), key=str) == brute_top(rows, k)
    assert T.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_in_groups(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], 0) for i in range(400)]
    monkeypatch.setattr(T, "GROUP", 6)
    monkeypatch.setattr(T, "BITS", 3)
    found = T.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found), key=str) == brute_top(rows, 20)


def brute_sequences(rows: list[tuple], rebuild: bool) -> dict:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}


def brute_trie(found: dict) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in own if len(found[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretches", [1, 4, 37])
def test_prefix_trie(spark, stretches):
    r = random.Random(8)
    rows = made_up(4, 50, 5) + [(-3, 0, "user", "x"), (-20, 0, "user", "x"), (200, 5, None, None)]
    copies = [(1000 + c, t, "user" if t % 2 == 0 else "assistant", f"say {r.choice('ab') if c > 60 else 'a'} {t}") for c in range(90) for t in range(4 if c < 60 else r.randrange(7))]
    turns = spark.createDataFrame(rows + copies, TURNS).withColumns({"part": F.lit(1), "kind": F.lit("x"), "words": F.lit(2)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", stretches)
    try:
        assert sorted(map(tuple, P.prefix_trie(P.sequences(turns)).collect()), key=str) == brute_trie(brute_sequences(rows + copies, False))
        own = turns.filter("conv_id >= 0 OR conv_id IS NULL")
        found = P.rebuilt(P.sequences(own), F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string")) % 4)
        assert sorted(map(tuple, P.prefix_trie(found).collect()), key=str) == brute_trie(brute_sequences([x for x in rows + copies if (x[0] or 0) >= 0], True))
        assert P.prefix_trie(P.sequences(turns.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stitching_at_every_place():
    """Stretches cut at all places, down to one sequence each, give the nodes of one stretch."""
    r = random.Random(9)
    found = {c: [(b"u", r.choice([b"a", b"b", b"c d"])) for _ in range(r.randrange(5))] for c in range(60)} | {c: [(b"u", b"a")] * 3 for c in range(60, 80)}
    rows = sorted(([hashlib.md5(b"".join(t)).digest() for t in turns], c, [len(t[1].split()) for t in turns]) for c, turns in found.items())
    expected = brute_trie(found)
    for cuts in ([0], range(80), range(0, 80, 3), sorted(r.sample(range(80), 12))):
        bounds = sorted({0, *cuts, 80})
        made = [x for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) for x in P.sweep(iter([(c, d, w) for d, c, w in rows[a:b]]), k)]
        parts = sorted((x for x in made if x[1] != "node"), key=lambda x: (x[0], x[2] < 0, abs(x[2]), x[1] == "ids", x[14] or 0))
        closed = list(P.stitch(iter(parts)))
        ids = {(x[0], x[2]): x[6] for x in closed if x[1] == "is"}
        nodes = [tuple(x) for x in (*made, *closed) if x[1] == "node"]
        assert sorted(((x[6], x[7], x[8] if x[8] is not None else ids.get((x[0], x[3])), *x[9:14]) for x in nodes), key=str) == expected
