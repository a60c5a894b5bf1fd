"""The strict review: all rules at stricter defaults, runs kept inside a section and out of dialogue, by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from . import analyses as A
from . import inside as I
from .frames import Frames

# Weights of the rules, and verbs of the senses that describe when `of` or `like` follows.
PRIORITY = {"repeated-phrase": 100, "repeated-starter": 95, "echo": 90, "nominal": 80, "tense-drift": 75, "pov-drift": 75, "dialogue-tag": 65, "adverbial-tag": 60, "cliche": 55, "long-sentence": 50, "monotony": 45, "passive": 35, "filter": 30, "hedge": 20, "adverb": 10}
SENSORY = ("smell", "smells", "smelled", "smelt", "taste", "tastes", "tasted")


def _row(df: DataFrame, rule: str, message: Column, sent: str | Column = "sent", last: str | Column | None = None) -> DataFrame:
    at = F.col(sent) if isinstance(sent, str) else sent
    end = at if last is None else F.col(last) if isinstance(last, str) else last
    return df.select("doc_id", F.lit(rule).alias("rule"), message.cast("string").alias("message"), at.cast("long").alias("sent"), end.cast("long").alias("last"), F.lit(PRIORITY[rule]).alias("priority"))


def _sure(totals: DataFrame, *kinds: str) -> DataFrame:
    """Documents with twelve classified sentences or more, four fifths of them of one kind."""
    n = [F.col(f"{k}_sentences") for k in kinds]
    return totals.filter((sum(n, F.lit(0)) >= 12) & (F.greatest(*n) * 5 >= sum(n, F.lit(0)) * 4)).select("doc_id", "dominant")


def review(f: Frames, spoken_tags: bool = True) -> DataFrame:
    """(doc_id, rule, message, sent, last, priority); sent and last are null for phrases, which have many places.

    spoken_tags: whether dialogue tags are judged; screenplays have none.
    """
    f = f.settled()
    words, sents = f.words, f.sentences
    place = words.groupBy("doc_id", F.col("sent").cast("long").alias("sent")).agg(F.max("section").alias("section"), F.bool_or("in_dialogue").alias("said"))
    section_at = words.select("doc_id", F.col("pos").cast("long").alias("pos"), "section")

    def inside(runs: DataFrame) -> DataFrame:
        """Runs (first, last) whose ends lie in one section."""
        a, b = place.select("doc_id", F.col("sent").alias("first"), F.col("section").alias("a")), place.select("doc_id", F.col("sent").alias("last"), F.col("section").alias("b"))
        return runs.join(a, ["doc_id", "first"]).join(b, ["doc_id", "last"]).filter(F.col("a").eqNullSafe(F.col("b"))).drop("a", "b")

    def narrated(runs: DataFrame) -> DataFrame:
        """Runs without a word of dialogue."""
        each = runs.withColumn("sent", F.explode(F.sequence("first", "last"))).join(place.filter("said").select("doc_id", "sent"), ["doc_id", "sent"], "left_semi")
        return runs.join(each.select("doc_id", "first", "last").distinct(), ["doc_id", "first", "last"], "left_anti")

    echo = I.echoes(f).withColumn("before", F.col("pos") - F.col("distance")).join(section_at, ["doc_id", "pos"]).join(section_at.select("doc_id", F.col("pos").alias("before"), F.col("section").alias("was")), ["doc_id", "before"]).filter(F.col("section").eqNullSafe(F.col("was")))
    runs = narrated(inside(A.starter_runs(sents, 3)))
    even = narrated(inside(A.monotony(sents).withColumn("last", F.col("first") + F.col("n") - 1)))
    listed = A.with_verbs(A.phrase_findings(sents, {"filter": V.FILTER_WORDS, "cliche": V.CLICHES, "nominal": V.NOMINALIZATIONS, "hedge": V.HEDGES}))
    of = lambda rule: listed.filter(F.col("rule") == rule)
    sensed = of("filter")
    nearby = words.groupBy("doc_id", F.col("sent").cast("long").alias("sent")).agg(F.array_sort(F.collect_list(F.struct("pos", "lower", "in_dialogue"))).alias("w"))
    sensed = sensed.join(nearby, ["doc_id", "sent"]).withColumn("at", F.col("pos") - F.col("w")[0]["pos"])
    covered = F.forall(F.slice("w", F.col("at").cast("int") + 1, F.col("n").cast("int")), lambda x: x["in_dialogue"])
    follows = F.coalesce(F.get("w", (F.col("at") + F.col("n")).cast("int"))["lower"].isin("of", "like"), F.lit(False))
    sensed = sensed.filter(~covered & ~(F.col("message").isin(*SENSORY) & follows))
    tense, pov = A.tense_sentences(words), A.pov_sentences(words)
    tense_n, pov_n = A.tense_totals(tense), A.pov_totals(pov)
    out = [
        _row(echo, "echo", F.concat(F.col("stem"), F.lit(" again after "), F.col("distance"), F.lit(" words"))),
        _row(I.repeats(f, 4, 6, 3), "repeated-phrase", F.concat(F.col("phrase"), F.lit(", times: "), F.col("count")), F.lit(None)),
        _row(runs, "repeated-starter", F.concat(F.col("word"), F.lit(", sentences: "), F.col("n")), "first", "last"),
        _row(even, "monotony", F.concat(F.lit("even sentences: "), F.col("n")), "first", "last"),
        _row(A.long_sentences(sents), "long-sentence", F.concat(F.lit("words: "), F.col("n_words"))),
        _row(of("cliche"), "cliche", F.col("message")),
        _row(of("nominal"), "nominal", F.col("message")),
        _row(A.passive(sents), "passive", F.col("message")),
        _row(sensed, "filter", F.col("message")),
        _row(of("hedge"), "hedge", F.col("message")),
        _row(A.adverbs(words), "adverb", F.col("message")),
        _row(inside(A.drift(tense, _sure(tense_n, "past", "present"), "tense")), "tense-drift", F.col("value"), "first", "last"),
        _row(inside(A.drift(pov, _sure(pov_n, "first", "second", "third"), "person")), "pov-drift", F.col("value"), "first", "last"),
    ]
    if spoken_tags:
        tags = A.attributions(f)
        first_in = sents.groupBy("doc_id", F.col("para").cast("long").alias("para")).agg(F.min("sent").alias("sent"), F.max("sent").alias("last"))
        tags = tags.join(first_in, ["doc_id", "para"])
        out += [_row(tags.filter("kind = 'showy'"), "dialogue-tag", F.col("verb"), "sent", "last"), _row(tags.filter("adverb"), "adverbial-tag", F.col("verb"), "sent", "last")]
    return reduce(DataFrame.unionByName, out)
