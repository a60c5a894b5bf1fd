"""One look at a document's words beside the analyses that take its sentences and words as rows."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstream.functions import fixed_values as V
from quillstream.operators import analyses as A
from quillstream.operators import corpus as W
from quillstream.operators import inside as I
from quillstream.operators import render as P
from quillstream.operators import report as R
from quillstream.operators import scanned as S
from quillstream.operators.frames import Frames

PIECES = (
    "the lanterns", "Lantern's light", "Mara Weiss", "glass-houses", "was really seen by", "been taken", "were Quickly lost", "and the the the", "of of of the", "is red", "was unmoved by", "ÉTÉ’s", "ΟΔΟΣ", "İstanbul’s",
    "Ⅰa Ⓐb", "नमस्ते", "É́clair 4x-y", "\U0001f40b whale", "’tis 3.14 a_b", 'he said “go home now” and "left', "Straße", "boxes churches flies gases bus", "yesterday’s ashes", "decision of the", "Élodie", "very nearly", "they've been being used by",
)
LISTS = {"tics": ("of the", "the the"), "hedges": ("of", "of of", "really"), "filters": ("was", "they've"), "cliches": ("the the the", "and the", "of of"), "nominal": {"the the": "the", "decision": "decide"}}


def frames(spark) -> Frames:
    r = random.Random(11)
    odd = [(100, ""), (101, "123 ..."), (102, None), (103, "One."), (104, "Go. Go now. Go on. Go far away from here, my dear friend. Go."), (None, "Nameless one. " * 5)]
    texts = [(k, "".join(r.choice(PIECES) + r.choice((" ", " ", " ", ". ", "! The ", ".\n", "\n\n")) for _ in range(r.randrange(150)))) for k in range(60)]
    return Frames.plain(spark.createDataFrame(texts + odd, "doc_id long, text string")).settled()


def rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)


def test_findings_are_those_of_the_analyses_by_row(spark, monkeypatch):
    f = frames(spark)
    monkeypatch.setattr(S, "WORDS", 700)
    for lists in (LISTS, {}):
        rules, table = R.phrases(**lists)
        want = A.with_verbs(A.phrase_findings(f.sentences, rules), table).unionByName(A.adverbs_of(f.sentences)).unionByName(A.passive(f.sentences))
        assert rows(R.list_findings(f, **lists)) == rows(want)
        kinds = {x.rule for x in want.collect()}
        assert {"adverbs", "passive", "hedges", "filter"} <= kinds and (lists is not LISTS or {"tics", "cliche", "nominal"} <= kinds)
    found = R.all_findings(f, **LISTS)
    known = F.col("doc_id").isNotNull()  # joins by id leave out what has none
    assert rows(found.filter(F.col("rule").isin(*R.RUNS) & known).drop("distance")) == rows(R.run_findings(f)) != []
    echoes = I.echoes(f)
    assert rows(found.filter("rule = 'echo'").select("doc_id", "message", "sent", "pos", "distance")) == rows(echoes) != []


def test_metrics_are_those_of_the_analyses_by_row(spark):
    f = frames(spark)
    base = f.words.groupBy(F.col("lower").alias("word")).agg((F.count("*") * 10.0).alias("per_million"))
    table = R.metrics(f, base, **LISTS).filter("doc_id IS NOT NULL")
    known = lambda df, *columns: rows(df.filter("doc_id IS NOT NULL").select("doc_id", *columns))
    some = table.filter("words > 0")
    counts = A.counts(f).columns[1:]
    assert known(table, *counts) == known(A.counts(f), *counts) and table.count() == 65
    assert known(some, "unique", "ttr", "mattr") == known(A.diversity(f.words), "unique", "ttr", "mattr")
    assert known(some, *R.SCORES) == known(A.readability(f.words, "doc_id"), *R.SCORES)
    lengths = A.summary(f.sentences.select("doc_id", F.col("n_words").alias("value")), "doc_id")
    assert known(some, "mean_sentence_words", "sentence_stdev", "sentence_words") == known(lengths, "mean", "stdev", "max")
    assert known(some, "dialogue_ratio") == known(A.dialogue_ratio(f.words, "doc_id"), "ratio")
    over = A.overused(f.words, base, 3.0, 3, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert known(table.filter("overused > 0"), "overused") == known(over, "n") != []
    found = R.all_findings(f, **LISTS).filter("doc_id IS NOT NULL").groupBy("doc_id").pivot("rule").count().fillna(0)
    for rule, name in {**{r: f"{r}_per_1k" for r in R.RATES if r != "echoes"}, "echo": "echoes_per_1k"}.items():
        rates = found.join(A.counts(f), "doc_id").select("doc_id", F.round(F.col(f"`{rule}`") * 1000.0 / F.col("words"), 4).alias("r"))
        assert known(table.filter(f"{name} > 0"), name) == known(rates.filter("r > 0"), "r") != []
    for rule, name in R.RUNS.items():
        assert known(table.filter(f"{name} > 0"), name) == known(found.filter(F.col(f"`{rule}`") > 0), f"`{rule}`")
    empty = table.filter("words = 0").select("doc_id", "ttr", "flesch_kincaid_grade", "sentence_words", "dialogue_ratio", "adverbs_per_1k", "cliches")
    assert rows(empty) == [(k, None, None, None, None, 0.0, 0) for k in (100, 101, 102)]
    assert R.metrics(f, **LISTS).agg(F.sum("overused")).first()[0] == 0
    assert V.STOPWORDS and R.metrics(Frames.plain(f.docs.limit(0).select("doc_id", F.col("source").alias("text")))).count() == 0


def test_ranked_findings_and_tops_are_those_of_all_rows(spark, monkeypatch):
    f = frames(spark)
    monkeypatch.setattr(S, "WORDS", 700)
    every = R.all_findings(f, **LISTS)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in V.REVISION_RANK.items() for x in kv]), F.col("rule"))
    every = every.withColumn("rank", F.when(F.col("rule") == "echo", 100 - F.col("distance")).otherwise(F.coalesce(rank, F.lit(0))).cast("long"))
    order = [F.desc("rank"), "pos", "message"]
    of = F.count("*").over(Window.partitionBy("doc_id"))
    want = every.withColumns({"k": F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy(*order)), "of": of}).filter("k <= 2")
    want = want.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter("nth <= 9").select("doc_id", "rule", "message", "pos", "rank", "nth", "of")
    assert rows(R.revisions_by_document(f, 2, 9, **LISTS).select(want.columns)) == rows(want) != []
    count = [F.count("*").alias("count")]
    words = f.words.filter(~F.col("lower").isin(*V.STOPWORDS) & (F.length("lower") >= 3)).groupBy("doc_id", F.col("lower").alias("item")).agg(*count)
    openers = f.sentences.groupBy("doc_id", F.col("first_word").alias("item")).agg(*count)
    for kind, most, df in (("word", 4, words), ("repeat", 3, I.repeats(f).select("doc_id", F.col("phrase").alias("item"), "count")), ("opener", 5, openers)):
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "item"))
        want = df.withColumn("rank", nth).filter(F.col("rank") <= most).select("doc_id", "rank", "item", "count")
        assert rows(W.tops_by_document(f, 4, 3, 5).filter(F.col("kind") == kind).drop("kind")) == rows(want) != []


def test_review_of_a_page_shuffles_few_findings(spark):
    """However many findings a document has, `each` of a rule leave its row."""
    f = Frames.plain(spark.createDataFrame([(1, "It was slowly seen by the slowly lanterns. " * 400)], "doc_id long, text string")).settled()
    of = {r["rule"]: r["count"] for r in R.all_findings(f).groupBy("rule").count().collect()}
    assert {r["rule"]: r["count"] for r in R._ranked(f, 3).groupBy("rule").count().collect()} == {k: min(n, 3) for k, n in of.items()}
    assert R.revisions_by_document(f).first().of == R.all_findings(f).count() > 1000


def test_a_page_looks_at_its_findings_and_tops_once(spark):
    """Each frame that pages() takes is in its plan once, so no finding is placed and no word counted again for another section."""
    f = frames(spark)
    review = R.revisions_by_document(f).select("doc_id", "nth", "of", "rule", "message", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("x").alias("text"))
    made = P.pages(A.counts(f), review, W.tops_by_document(f))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert made.filter("doc_id IS NOT NULL").count() == 65
    html = made.filter("doc_id = 103").first().html
    assert "<li>one <b>1</b></li>" in html and html.count('<p class="muted">None</p>') == 3  # neither findings nor content words nor repeats
