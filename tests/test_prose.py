"""Segmentation and analyses on small texts, and a sample of queries against DuckDB."""

from __future__ import annotations

import random

import duckdb
import pytest

import __spark_entry__ as entry
from quillstream.operators import analyses as A
from quillstream.operators import history as H
from quillstream.operators.frames import Frames
from quillstream.sources.markup import markdown, screenplay

SF = "/root/testdata/sf0.001"


def frames(spark, text):
    return Frames.plain(spark.createDataFrame([(1, text)], "doc_id long, text string"))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dr. Weiss came in. She sat.", ["Dr. Weiss came in.", "She sat."]),
        ("J. Doe left… Then it rained!", ["J. Doe left…", "Then it rained!"]),
        ("“Stop!” she cried. Nobody did.", ["“Stop!” she cried.", "Nobody did."]),
        ("One.\n\nTwo.", ["One.", "Two."]),
        ("", []),
        ("--- ...", []),
    ],
)
def test_sentences(spark, text, expected):
    assert [r.text.strip() for r in frames(spark, text).sentences.orderBy("sent").collect()] == expected


def test_words_and_dialogue(spark):
    rows = frames(spark, 'She said “go home now” twice. "Well-kept, isn\'t it?').words.orderBy("pos").collect()
    assert [r.lower for r in rows] == ["she", "said", "go", "home", "now", "twice", "well-kept", "isn't", "it"]
    assert [r.in_dialogue for r in rows] == [False, False, True, True, True, False, True, True, True]


def test_passive(spark):
    found = A.passive(frames(spark, "It was quickly forgotten by all. He was tired. He was tired by noon. She had been seen.").sentences)
    assert sorted(r.message for r in found.collect()) == ["been seen", "was quickly forgotten by", "was tired by"]


def test_echo_and_runs(spark):
    f = frames(spark, "Lantern light fell. The lanterns swayed. The end came. The end.")
    assert [(r.stem, r.distance) for r in A.echoes(f.words).collect()] == [("lantern", 4)]
    assert [(r.word, r.n) for r in A.starter_runs(f.sentences, 3).collect()] == [("the", 3)]


def test_markdown_and_screenplay():
    m = markdown("---\na: b\n---\n# Title *x*\n\nSome `code` and [link](http://x.y).\n\n- item\n")
    assert m.headings == [(1, "Title x", 4)] and "code" not in "".join(m.prose) and "link" in "".join(m.prose)
    s = screenplay("INT. HOUSE - DAY\n\nMARA\n(quiet)\nHello there.\n\nShe leaves.")
    assert s.headings == [(2, "INT. HOUSE - DAY", 1)] and "MARA" not in "".join(s.prose)


def test_history(spark):
    assert H._lcs("a b c d".split(), "a x c d".split()) == 3
    revs = spark.createDataFrame([(1, 0, "one two\nthree"), (1, 1, "one two\nfour five"), (2, 0, "gone")], "doc_id long, rev int, text string")
    assert [tuple(r) for r in H.changed_lines(revs, 0, 1).collect()] == [(1, 2, 2)]
    assert sorted(tuple(r) for r in H.progress(revs, 0, 1).collect()) == [(1, 3, 4, 1), (2, 1, 0, -1)]


@pytest.mark.parametrize("name", ["counts_by_doc", "hapax", "echoes", "passive", "tense_drift", "rhythm_monotony", "repeats", "revisions_top", "report_metrics", "trend", "name_variants", "builtin_lists"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    expected = con.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def brute_clusters(names, close):
    clusters: list[list[str]] = []
    for name in sorted(names):
        home = next((c for c in clusters if all(close(m, name) for m in c)), None)
        clusters.append([name]) if home is None else home.append(name)
    return [c for c in clusters if len(c) > 1]


def test_name_variants_of_a_long_chain(spark):
    names = ["a" * 7]
    for k in range(13):
        last = names[-1]
        names.append(last[: k % 7] + chr(ord(last[k % 7]) + 1) + last[k % 7 + 1 :])
    chain = list(zip(names[:-1], names[1:], strict=True))  # each is near the next alone
    counts = spark.createDataFrame([(n, k + 1) for k, n in enumerate(names)], "name string, count long")
    found = A.name_variants(counts, spark.createDataFrame(chain, "earlier string, later string")).collect()
    expected = brute_clusters(names, lambda m, n: (m, n) in chain)
    assert sorted(r.name for r in found) == sorted(n for c in expected for n in c)
    own = {n: k + 1 for k, n in enumerate(names)}
    for c in expected:
        lead = min(c, key=lambda n: (-own[n], n))
        assert {r["name"] for r in found if r["lead"] == lead} == set(c)
        assert {r["total"] for r in found if r["lead"] == lead} == {sum(own[n] for n in c)}
    totals = [r["total"] for r in found]
    assert totals == sorted(totals, reverse=True)


def test_word_and_line_diffs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2)]
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
        for bits in (1 << 28, 20):
            pairs = H.common(a, b, bits)
            assert len(pairs) == size[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        tags = H.word_diff(" ".join(a), " ".join(b))
        assert [w for t, w in tags if t != "insert"] == a and [w for t, w in tags if t != "delete"] == b


def test_monotony_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(" ".join(["Word"] * rng.choice((2, 3, 4, 5, 6, 7, 9))) + "." for _ in range(rng.randrange(40))) for _ in range(40)]
    f = Frames.plain(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expected = set()
    for doc_id, text in enumerate(texts):
        n = [len(s.split()) for s in text.split(".") if s.split()]
        i = 0
        while i < len(n):
            k = 1
            while i + k < len(n) and max(n[i : i + k + 1]) - min(n[i : i + k + 1]) <= 3:
                k += 1
            if k >= 4:
                expected.add((doc_id, i, k))
            i += k if k >= 4 else 1
    assert expected and {tuple(r) for r in A.monotony(f.sentences).collect()} == expected


def test_check_since_counts_changed_lines_alone(spark):
    old = "It was seen by all.\nThe lantern fell slowly.\nNothing else."
    new = "It was seen by all.\nThe lantern fell quickly.\nNothing else. The lantern was taken away, I think that it was."
    revs = spark.createDataFrame([(1, 0, old), (1, 1, new)], "doc_id long, rev int, text string")
    found = {r["rule"]: (r["words"], r["count"]) for r in H.check_since(revs, 0, 1, hedges=("i think",)).collect()}
    assert found["adverbs"] == (16, 1) and found["passive"] == (16, 1) and found["hedges"] == (16, 1) and found["echo"] == (16, 1)
    assert found["longest-sentence"] == (16, 10)


def test_settled_frames_need_no_exchange_by_document(spark):
    f = Frames.plain(spark.createDataFrame([(1, "One. Two one.")], "doc_id long, text string")).settled()
    assert f.settled() is f
    plan = A.echoes(f.words)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert A.diversity(f.words).collect()[0].unique == 2
