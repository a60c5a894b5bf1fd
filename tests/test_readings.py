"""Readings by a stand-in for a model: batches, ledger, voices, scenes tiled over a text."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quillstream.operators import readings as R
from quillstream.operators.frames import Frames
from quillstream.plans import evidence_queries as Q

DOCS = "doc_id long, text string"


def test_batches_hold_every_line_within_the_limit(spark):
    r = random.Random(2)
    texts = {k: "\n".join("ü" * r.randrange(30) + f" {i}" for i in range(r.randrange(1, 12))) for k in range(50)}
    texts[7] = "long " * 300 + "\nshort"
    docs = spark.createDataFrame([*texts.items(), (90, None), (91, ""), (None, "left out")], DOCS).repartition(6)
    for keys, most in (((), 400), (("half",), 400), ((), 1 << 20)):
        found = R.batches(docs.withColumn("half", F.col("doc_id") % 2), most, *keys).orderBy(*keys, "batch").collect()
        assert all(len(b.text.encode()) <= most for b in found)
        lines = [(int(a), int(b), c) for row in found for x in row.text.split("\n") for a, b, c in [x.replace("| ", ":", 1).split(":", 2)]]
        whole = {}
        for doc, line, text in lines:
            whole.setdefault(doc, {}).setdefault(line, []).append(text)
        assert {k: "\n".join("".join(v[n]) for n in sorted(v)) for k, v in whole.items()} == {**texts, 91: ""}
        if not keys:
            assert [x[:2] for x in lines] == sorted(x[:2] for x in lines)
            assert len(found) == (1 if most > 4000 else len(found)) and (most > 4000 or len(found) > 10)


def odd_reply(prompt: str) -> str:
    if "nothing" in prompt:
        return "not json"
    facts = [
        {"entity": "Mara", "attribute": "Eyes", "value": "green", "file": "1", "line": 1, "quote": "green eyes"},
        {"entity": " mara", "attribute": "eyes", "value": "Blue", "file": "2", "line": 9, "quote": "blue eyes"},
        {"entity": "mara", "attribute": "eyes", "value": "blue ", "file": "x", "line": 3, "quote": "blue eyes"},
        {"entity": "Tomas", "attribute": "age", "value": "30", "file": "1", "line": 4, "quote": "not there"},
    ]
    against = [{"entity": "Mara", "attribute": "eyes", "facts": f, "note": ""} for f in ([0, 1], [0, 4], [3, -1, 2], [])]
    return json.dumps({"facts": facts, "contradictions": against, "more": 1})


def test_ledger(spark):
    docs = spark.createDataFrame([(1, "She has green eyes.\n"), (2, "a\nb\nHer blue eyes."), (3, None)], DOCS)
    ledger = R.Ledger(docs, odd_reply)
    facts = {r.fact: (r.doc_id, r.line, r.column, r.verified) for r in ledger.facts().collect()}
    assert facts == {0: (1, 1, 9, True), 1: (2, 3, 5, True), 2: (None, 3, 0, False), 3: (1, 4, 0, False)}
    assert sorted((r.number, r.facts) for r in ledger.contradictions().collect()) == [(0, [0, 1]), (2, [3, 2])]
    assert {(r.entity, r.value, r.facts) for r in ledger.conflicts().collect()} == {("mara", "green", 1), ("mara", "blue", 2)}
    assert R.Ledger(docs.withColumn("text", F.lit("nothing")), odd_reply).facts().count() == 0
    assert R.Ledger(docs.limit(0), odd_reply).facts().count() == 0


def test_voices(spark):
    text = "# One\n\n" + "\n\n".join(f'"{"Well " * (k + 1)}now," said Mara.\n\n"No {"more " * (k % 3)}of it," said Tomas.' for k in range(9))
    f = Frames.marked_up(spark.createDataFrame([(1, "markdown", text), (2, "markdown", text.replace("Tomas", "Anna"))], "doc_id long, format string, source string")).settled()
    said = Q.A.attributions(f)
    voices = R.Voices(Q.sources(f), said, Q.paragraph_lines(f), Q.tell_voices, most=300, sample=5)
    assert [(r.name, r.lines) for r in voices.profiles().collect()] == [("anna", 5), ("mara", 5), ("tomas", 5)]
    found = voices.findings().collect()
    assert {r.character for r in found} == {"anna", "mara", "tomas"} and all(r.verified for r in found)
    lines = text.split("\n")
    assert all(r.quote.strip() in lines[r.line - 1].replace("Tomas", "Anna" if r.doc_id == 2 else "Tomas") for r in found)
    every = R.Voices(Q.sources(f), said, Q.paragraph_lines(f), Q.tell_voices)
    assert [(r.name, r.lines) for r in every.profiles().collect()] == [("mara", 18), ("anna", 9), ("tomas", 9)]


def brute_tiles(claims: list[tuple], lines: int) -> list[tuple]:
    owner: list[str | None] = [None] * (lines + 1)
    starts = {}
    for line, last, title in claims:
        first, until = max(line if line is not None else 1, 1), lines if last is None else min(last, lines)
        if first <= lines and (last is None or last >= first):
            if first not in starts or (-until, title) < starts[first]:
                starts[first] = (-until, title)
    for k, first in enumerate(sorted(starts)):
        until, title = -starts[first][0], starts[first][1]
        stop = min([until, *[x - 1 for x in starts if x > first]])
        for n in range(first, stop + 1):
            owner[n] = f"{title}#{k}"
    out, n = [], 1
    while n <= lines:
        end = n
        while end < lines and owner[end + 1] == owner[n]:
            end += 1
        out.append((n, end, owner[n] and owner[n].split("#")[0]))
        n = end + 1
    return out


def test_tiles(spark):
    r = random.Random(11)
    sizes = {k: r.randrange(1, 30) for k in range(40)}
    claims = [(k, r.choice([None, 0, *range(1, 34)]), r.choice([None, None, *range(1, 34)]), r.choice("abc")) for k in sizes for _ in range(r.randrange(6))]
    found = R.tiles(spark.createDataFrame(claims, "doc_id long, line long, last long, title string"), spark.createDataFrame([*sizes.items(), (99, 0)], "doc_id long, lines long"))
    by = {}
    for x in found.orderBy("doc_id", "tile").collect():
        by.setdefault(x.doc_id, []).append((x.first, x.last, x.title))
    assert by == {k: brute_tiles([c[1:] for c in claims if c[0] == k], n) for k, n in sizes.items()}


def test_scenes_are_measured(spark):
    text = "Before it all.\n\n# Conversation 1\n\nHe ran home quickly. She stayed.\n\nA gap line here.\n\n# Conversation 2\n\n\"Yes,\" she said."
    f = Frames.marked_up(spark.createDataFrame([(1, "markdown", text)], "doc_id long, format string, source string"))
    found = R.scenes(f, Q.sources(f), Q.tell_scenes).orderBy("first").collect()
    assert [(r.first, r.last, r.title, r.words, r.adverbs) for r in found] == [(1, 2, None, 3, 0), (3, 5, "Conversation 1", 6, 1), (6, 8, None, 4, 0), (9, 11, "Conversation 2", 3, 0)]
    assert found[3].dialogue_ratio == 0.3333 and found[1].mean_sentence_words == 3.0 and found[3].verdict == "keep" and found[1].verified
