"""The strict review and citations, on small texts."""

from __future__ import annotations

import json

from quillstream.operators import evidence as E
from quillstream.operators import strict as S
from quillstream.operators.frames import Frames


def marked(spark, text):
    return Frames.marked_up(spark.createDataFrame([(1, "markdown", text)], "doc_id long, format string, source string"))


def rules(df):
    return sorted({(r.rule, r.message) for r in df.collect()})


def test_strict_review(spark):
    text = "# One\n\nThe lantern swung.\n\n# Two\n\nThe lantern fell, and the lantern broke. It smelled of smoke. He smelled trouble.\n\n“I smelled nothing,” exclaimed Tomas."
    found = S.review(marked(spark, text))
    kept = rules(found)
    assert [m for r, m in kept if r == "echo" and "lantern" in m] == ["lantern again after 4 words"]  # not over the heading
    places = [(r.message, r.sent) for r in found.collect() if r.rule == "filter" and "smell" in r.message]
    assert places == [("smelled", 3)]  # neither `smelled of` nor the one in dialogue
    assert ("dialogue-tag", "exclaimed") in kept
    assert not [1 for r, _ in rules(S.review(marked(spark, text), spoken_tags=False)) if r.endswith("-tag")]
    assert S.review(marked(spark, "")).count() == 0


def test_strict_runs_and_drift(spark):
    told = "He waited there today. " * 12
    drift = "She is here now. He has it now. It does so now."
    kept = S.review(marked(spark, f"# A\n\n{told}\n\n{drift}")).collect()
    assert [(r.message, r.sent, r.last) for r in kept if r.rule == "tense-drift"] == [("present", 12, 14)]
    assert [r.message for r in kept if r.rule == "repeated-starter"] == ["he, sentences: 12"]
    split = S.review(marked(spark, f"# A\n\n{told}\n\nShe is here now. He has it now.\n\n# B\n\nIt does so now.")).collect()
    assert not [1 for r in split if r.rule == "tense-drift"]


def test_pins(spark):
    docs = spark.createDataFrame([(1, "red fox\nthe red fox ran\n\nred (fox) red\nfox")], "doc_id long, text string")
    asked = [(1, 4, " red fox "), (1, 4, " red fox "), (1, 1, "red\nfox"), (1, 9, "(fox)"), (1, 3, "wolf"), (1, 2, "  "), (2, 7, "red"), (1, None, None)]
    cited = spark.createDataFrame(asked, "doc_id long, line long, quote string")
    rows = sorted((r.doc_id, r.line, r.column, r.verified) for r in E.pin(docs, cited).collect())
    assert rows == [(1, 1, 0, False), (1, 2, 0, False), (1, 2, 5, True), (1, 2, 5, True), (1, 3, 0, False), (1, 4, 5, True), (1, 4, 11, True), (2, 7, 0, False)]
    assert [r.numbered for r in E.numbered(docs).orderBy("line").collect()][1] == "1:2| the red fox ran"
    assert E.fits(docs).first().fits


def test_explain(spark):
    found = spark.createDataFrame([(1, "hedges", "perhaps", 1, 5, 1, 12, "x"), (1, "adverbs", "softly", 2, 1, 2, 7, "y")], "doc_id long, rule string, message string, line long, column long, end_line long, end_column long, text string")
    reply = json.dumps([{"index": 1, "verdict": "fix", "note": "cut"}, {"index": 9, "verdict": "fix"}, {"index": 0, "verdict": "maybe"}])
    prompts = []
    rows = E.explain(found, lambda p: prompts.append(p) or reply).collect()
    assert [(r.message, r.verdict, r.note) for r in rows] == [("softly", "fix", "cut")] and prompts[0].startswith("0: hedges: perhaps")
