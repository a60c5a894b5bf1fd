"""Views on part of a text: the index of findings against brute force, the plan that reads it, points at all resolutions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillstream.operators import charts as C
from quillstream.operators.viewport import Viewport

FOUND = "doc_id long, rule string, message string, line long, column long, end_line long, end_column long"


def test_a_view_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(5), r.choice("abc"), f"m{r.randrange(3)}", n := r.randrange(1, 400), r.randrange(9), n + r.choice([0, 0, 0, 1, 30, 300]), 1) for _ in range(900)]
    rows += [*rows[:50], (None, "a", "m", 1, 1, 1, 1), (3, "a", "m", None, None, None, None)]
    index = Viewport(spark, str(tmp_path / "index"), 16).build(spark.createDataFrame(rows, FOUND).withColumn("text", F.lit("x")))
    best = {}
    for doc, rule, message, *place in rows:
        if doc is not None and place[0] is not None:
            best[doc, rule, *place] = min(message, best.get((doc, rule, *place), message))
    whole = [(k[0], k[1], m, *k[2:]) for k, m in best.items()]
    views = [(d, a, a + size) for d in range(6) for a, size in ((1, 0), (17, 3), (200, 60), (399, 0), (900, 5), (1, 1000))]
    for doc, first, last in views[::2]:
        expected = sorted(x for x in whole if x[0] == doc and x[3] <= last and x[5] >= first)
        assert sorted(tuple(x)[:7] for x in index.overlapping(doc, first, last).drop("text").select(*[c.split()[0] for c in FOUND.split(", ")]).collect()) == expected
    shown, counts = index.view(spark.createDataFrame(views, "doc_id long, first long, last long"), ("a", "b"), 7)
    by = {}
    for x in shown.collect():
        by.setdefault((x.doc_id, x.first, x.last), []).append(x)
    for doc, first, last in views:
        inside = [x for x in whole if x[0] == doc and x[3] <= last and x[5] >= first]
        kept = sorted((x[3], x[4], x[5], x[6], x[1], x[2]) for x in inside if x[1] in "ab")
        got = sorted(by.get((doc, first, last), []), key=lambda x: x.nth)
        assert [(x.line, x.column, x.end_line, x.end_column, x.rule, x.message) for x in got] == kept[:7]
        assert all(x.total == len(kept) and x.truncated == (len(kept) > 7) for x in got)
    told = {(x.doc_id, x.first, x.last, x.rule): x["count"] for x in counts.collect()}
    assert told == {(*v, rule): n for v in views for rule in "abc" if (n := sum(x[0] == v[0] and x[1] == rule and x[3] <= v[2] and x[5] >= v[1] for x in whole))}
    assert sum(x.findings for x in index.summary().collect()) == len(whole)


def test_a_view_reads_its_buckets_alone(spark, tmp_path, capsys):
    rows = [(1, "a", "m", n, 1, n, 2) for n in range(1, 2000)]
    index = Viewport(spark, str(tmp_path / "index"), 16).build(spark.createDataFrame(rows, FOUND))
    found = index.overlapping(1, 1600, 1610)
    assert found.count() == 11
    found.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(bucket,100)" in pushed and "LessThanOrEqual(bucket,100)" in pushed and "EqualTo(doc_id,1)" in pushed
    assert index.overlapping(2, 1, 5).count() == 0


SERIES = "doc_id long, section long, sent long, para long, words long, first_word long, paragraph_words long, dialogue_words long, findings long, variation double"


def test_points_have_a_limit(spark):
    rows = [(d, k // 40 if d else -1, k, k // 3, 2, 2 * k + 1, 6, 1, 0, 50.0) for d in range(2) for k in range(120)]
    series = spark.createDataFrame(rows, SERIES)
    found = C.resolutions(series, 40)
    kept = {(x.doc_id, x.resolution, x.target) for x in found.collect()}
    assert kept == {(1, "chapter", 4), (1, "chapter", 8)}  # 3 sections of 4 and of 8 points; 16 and all overviews have more than 40
    assert {(x.resolution, x.target) for x in found.filter("automatic").collect()} == {("chapter", 8)}
    views = spark.createDataFrame([(0, 4, 6), (1, 0, 119)], "doc_id long, first long, last long")
    sentences = C.visible_points(series, views, most=100).collect()
    assert sorted((x.doc_id, x.point) for x in sentences) == [(0, 4), (0, 5), (0, 6)]
    paragraphs = C.visible_points(series, views, "paragraph").filter("doc_id = 0").orderBy("point").collect()
    assert [(x.point, x.first_sentence, x.last_sentence, x.paragraph_length) for x in paragraphs] == [(1, 3, 5, 6.0), (2, 6, 8, 6.0)]
    assert C.resolutions(series.limit(0)).count() == 0
