"""What looks across documents and revisions: diversity of all words, kept metrics, renames, dates, sampled revisions."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.operators import analyses as A
from quillstream.operators import corpus as C
from quillstream.operators import history as H
from quillstream.operators import kept as K
from quillstream.operators import timeline as T
from quillstream.operators.frames import Frames

DOCS = "doc_id long, text string"


def moving(words: list[str], window: int) -> tuple:
    n, unique = len(words), len(set(words))
    if n <= window or window < 2:
        return n, unique, round(unique / max(n, 1) + 1e-9, 4), round(unique / max(n, 1) + 1e-9, 4)
    mean = sum(len(set(words[i : i + window])) for i in range(n - window + 1)) / (n - window + 1) / window
    return n, unique, round(unique / n + 1e-9, 4), round(mean + 1e-9, 4)


@pytest.mark.parametrize("window", [2, 5, 50])
def test_diversity_runs_across_documents_and_partitions(spark, window):
    r = random.Random(window)
    texts = {k: " ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(r.choice([0, 1, 2, 3, 120, 7]))) for k in range(60)}
    docs = spark.createDataFrame([*texts.items(), (None, "zz ab zz"), (70, None), (71, "")], DOCS).repartition(7)
    words = ["zz", "ab", "zz", *" ".join(texts[k] for k in range(60)).split()]
    for n in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = C.diversity_total(Frames.plain(docs), window).collect()
        assert [tuple(x) for x in found] == [moving(words, window)]
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_diversity_of_little(spark):
    for text, expected in (("", (0, 0, 0.0, 0.0)), ("One two one.", (3, 2, 0.6667, 0.6667))):
        assert tuple(C.diversity_total(Frames.plain(spark.createDataFrame([(1, text)], DOCS))).first()) == expected
    assert C.diversity_total(Frames.plain(spark.createDataFrame([], DOCS))).first()[0] == 0


def test_metrics_are_kept_by_content(spark, tmp_path):
    measure = lambda texts: A.counts(Frames.plain(texts)).select("doc_id", "words", "sentences")
    store = K.Store(spark, str(tmp_path / "kept"))
    rows = [(k, f"Words of text {k % 90}. More of it.") for k in range(100)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, DOCS)
    first = {tuple(r) for r in store.refresh(docs, measure, {"echoes": 50}).collect()}
    assert store.measured == 92 and len(first) == len({tuple(r) for r in measure(docs).collect()})
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "Something else entirely.").otherwise(F.col("text")))
    found = {tuple(r) for r in store.refresh(changed, measure, {"echoes": 50}).collect()}
    assert store.measured == 1 and found == {tuple(r) for r in measure(changed).collect()}
    store.refresh(docs, measure, {"echoes": 50})
    assert store.measured == 0  # the former text is still known
    store.refresh(docs, measure, {"echoes": 51})
    assert store.measured == 92  # other settings, other keys
    assert K.settings_key({"a": [1, 2], "b": {"x": 1}}) == K.settings_key({"b": {"x": 1}, "a": (2, 1)})


def test_kept_rows_are_tidied_and_broken_runs_ignored(spark, tmp_path):
    measure = lambda texts: A.counts(Frames.plain(texts)).select("doc_id", "words")
    store = K.Store(spark, str(tmp_path / "kept"))
    store.refresh(spark.createDataFrame([(k, f"text {k}") for k in range(50)], DOCS), measure, {})
    few = spark.createDataFrame([(k, f"text {k}") for k in range(5)], DOCS)
    assert store.refresh(few, measure, {}).count() == 5 and store.rows().count() == 5
    broken = tmp_path / "kept" / "rows-broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half a file")
    assert store.refresh(few, measure, {}).count() == 5 and store.measured == 0
    assert store.refresh(few.limit(0), measure, {}).count() == 0


def brute_names(renames: list[tuple]) -> set:
    """Files told apart by walking through the revisions in turn."""
    spans, at, freed = [], {}, {}
    for rev in sorted({r for r, _, _ in renames}):
        moves = [(old, new) for r, old, new in renames if r == rev]
        taken = []
        for old, new in moves:
            if old not in at:
                at[old] = [(old, freed.get(old)), None]
            taken.append((at.pop(old), old, new))
        for (file, since), old, _ in taken:
            spans.append((*file, old, since, rev))
            freed[old] = rev
        for (file, _), _, new in taken:
            if new in at:
                other, since = at.pop(new)
                spans.append((*other, new, since, None))
            at[new] = [file, rev]
    return set(spans) | {(*file, name, since, None) for name, (file, since) in at.items()}


def test_names_in_time(spark):
    chain = [(k, f"n{k}", f"n{k + 1}") for k in range(1, 40)]
    for renames in (
        chain,
        [(1, "a", "b"), (2, "b", "a"), (3, "a", "b")],  # a circle
        [(1, "a", "b"), (1, "b", "a"), (3, "a", "c")],  # a swap
        [(1, "z", "a"), (3, "a", "b"), (5, "a", "c")],  # a name used again by another file
        [(1, "a", "b"), (2, "c", "a"), (3, "a", "d"), (4, "b", "a")],
    ):
        found = T.names_in_time(spark.createDataFrame(renames, "rev long, old string, new string"))
        assert {tuple(r) for r in found.collect()} == brute_names(renames)
    odd = spark.createDataFrame([(1, "a", "a"), (None, "a", "b"), (2, None, "b"), (3, "a", "b"), (3, "a", "b"), (3, "a", "c")], "rev long, old string, new string")
    assert {tuple(r) for r in T.names_in_time(odd).collect()} == {("a", None, "a", None, 3), ("a", None, "b", 3, None)}
    assert T.names_in_time(odd.limit(0)).count() == 0


def test_random_renames(spark):
    r = random.Random(4)
    for seed in range(3):
        standing, renames = {f"f{k}" for k in range(8)}, []
        for rev in range(1, 14):
            olds = r.sample(sorted(standing), r.randrange(4))
            free = sorted(({f"f{k}" for k in range(12)} - standing) | set(olds))
            news = r.sample(free, len(olds))
            renames += [(rev, a, b) for a, b in zip(olds, news, strict=True) if a != b]
            standing = (standing - set(olds)) | set(news)
        found = T.names_in_time(spark.createDataFrame(renames, "rev long, old string, new string"))
        assert {tuple(x) for x in found.collect()} == brute_names(renames), seed


def test_a_renamed_text_is_followed(spark):
    versions = spark.createDataFrame([("a", 1, "one two three"), ("a", 2, None), ("b", 2, "one two three"), ("b", 3, "one two three four"), ("c", 3, "new"), ("d", 1, "old"), ("d", 2, None)], "name string, rev long, text string")
    renames = spark.createDataFrame([(2, "a", "b")], "rev long, old string, new string")
    found = {tuple(r) for r in T.with_total(T.progress_followed(versions, renames, 1, 3)).collect()}
    assert found == {("b", 3, 4, 1, False), ("c", 0, 1, 1, False), (None, 3, 5, 2, True)}
    trend = T.trend_followed(versions, renames, [1, 2, 3], ("one two",)).orderBy("rev").collect()
    assert [(r.rev, r.words, r.cliches_per_1k) for r in trend] == [(1, 3, 333.3333), (2, 3, 333.3333), (3, 5, 200.0)]


def test_dates(spark):
    log = spark.createDataFrame([(1, datetime(2024, 1, 1, 9)), (2, datetime(2024, 1, 1, 18)), (3, datetime(2024, 1, 1, 18)), (4, datetime(2024, 3, 1)), (5, None)], "rev long, ts timestamp")
    specs = ["2023-12-31", "2024-01-01", "2024-01-01T09:00:00", "2024-01-01 18:00:00", "2024-02-29", "2024-02-30", "2024-03-01", "2031-01-01", "5", "v1", None]
    found = {r.spec: (r.rev, r.kind) for r in T.resolve(spark.createDataFrame([(x,) for x in specs], "spec string"), log).collect()}
    none = (None, "no revision before")
    assert found == {"2023-12-31": none, "2024-01-01": none, "2024-01-01T09:00:00": (1, "date"), "2024-01-01 18:00:00": (3, "date"), "2024-02-29": (3, "date"), "2024-02-30": (None, "unknown"), "2024-03-01": (4, "date"), "2031-01-01": (4, "date"), "5": (5, "rev"), "v1": (None, "unknown"), None: (None, "unknown")}
    assert {r.kind for r in T.resolve(spark.createDataFrame([("2024-01-01",)], "spec string"), log.limit(0)).collect()} == {"no revision before"}
    by_name = T.as_of(spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "name string, at long"), spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "name string, at long, value string"), "at", "value", "name")
    assert {tuple(r) for r in by_name.collect()} == {("a", 5, "y"), ("a", 1, None), ("b", 9, None)}


def test_sampled_revisions(spark):
    revs = spark.createDataFrame([(r * 3,) for r in range(101)] * 2, "rev long").repartition(5)
    assert H.sampled_revs(revs, 5) == [0, 75, 150, 225, 300]
    assert H.sampled_revs(revs, 1) == [300]
    assert H.sampled_revs(revs.filter("rev < 10"), 5) == [0, 3, 6, 9]
    assert H.sampled_revs(revs.limit(0), 5) == []
