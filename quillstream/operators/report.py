"""Composites: all list findings, one wide row of metrics a document, ranked revisions, thresholds."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from . import analyses as A
from . import inside as I
from . import scanned as S
from .frames import Frames
from .lineage import cut

#: rule, kind (max or min), limit, severity
SAMPLE_LIMITS = (
    ("adverbs_per_1k", "max", 8.0, "error"),
    ("passive_per_1k", "max", 3.0, "warn"),
    ("hedges_per_1k", "max", 20.0, "error"),
    ("nominal_per_1k", "max", 5.0, "warn"),
    ("echoes_per_1k", "max", 150.0, "warn"),
    ("overused", "max", 2.0, "warn"),
    ("cliches", "max", 1.0, "error"),
    ("repeated_starter_runs", "max", 0.0, "warn"),
    ("monotonous_runs", "max", 3.0, "warn"),
    ("sentence_words", "max", 60.0, "error"),
    ("mattr", "min", 0.8, "warn"),
    ("flesch_kincaid_grade", "max", 12.0, "error"),
    ("dialogue_ratio", "max", 0.9, "error"),
)


def phrases(tics: Iterable[str] = (), hedges: Iterable[str] = V.HEDGES, filters: Iterable[str] = V.FILTER_WORDS, cliches: Iterable[str] = V.CLICHES, nominal: dict[str, str] | None = None) -> tuple[dict, dict]:
    """Phrases by rule, and the verbs of nominalizations."""
    table = V.NOMINALIZATIONS if nominal is None else nominal
    return {"tics": tics, "hedges": hedges, "filter": filters, "cliche": cliches, "nominal": table}, table


def list_findings(f: Frames, **lists) -> DataFrame:
    """Findings of all list analyses: (doc_id, rule, message, sent, pos, n), pos being the first word's place in the document."""
    return S.findings(f, *phrases(**lists)).drop("distance")


def all_findings(f: Frames, **lists) -> DataFrame:
    """The rows of list_findings(), run_findings() and inside.echoes() (rule echo, its stem as message), which alone have a distance."""
    return S.findings(f, *phrases(**lists), runs=True, echoes=50)


def _runs(f: Frames, starter_run: int = 3, rhythm_run: int = 4, tolerance: int = 3, long: int = 40) -> DataFrame:
    """(doc_id, rule, message, sent) of repeated openers, even rhythm and long sentences."""
    s = f.sentences
    starters = A.starter_runs(s, starter_run).select("doc_id", F.lit("starters").alias("rule"), F.concat(F.col("word"), F.lit(" opens "), F.col("n"), F.lit(" sentences")).alias("message"), F.col("first").alias("sent"))
    even = A.monotony(s, rhythm_run, tolerance).select("doc_id", F.lit("monotony").alias("rule"), F.concat(F.col("n"), F.lit(" sentences of like length")).alias("message"), F.col("first").alias("sent"))
    wide = A.long_sentences(s, long).select("doc_id", F.lit("long-sentence").alias("rule"), F.concat(F.col("n_words"), F.lit(" words")).alias("message"), "sent")
    return starters.unionByName(even).unionByName(wide)


def run_findings(f: Frames, starter_run: int = 3, rhythm_run: int = 4, tolerance: int = 3, long: int = 40) -> DataFrame:
    """Repeated openers, even rhythm and long sentences as findings, at their first sentence and word."""
    at = f.sentences.select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("first").alias("pos"), F.col("n_words").cast("long").alias("n"))
    return _runs(f, starter_run, rhythm_run, tolerance, long).join(at, ["doc_id", "sent"]).select("doc_id", "rule", "message", "sent", "pos", "n")


RATES = ("adverbs", "cliche", "filter", "hedges", "nominal", "passive", "tics", "echoes")
RUNS = {"starters": "repeated_starter_runs", "monotony": "monotonous_runs", "long-sentence": "long_sentences"}


def metrics(f: Frames, baseline: DataFrame | None = None, **lists) -> DataFrame:
    """One row a document: counts, diversity, sentence lengths, readability, dialogue, runs, and findings a thousand words.

    overused counts the document's words that baseline (word, per_million) shows as overused; without baseline it is 0. A document's
    words are looked at once, in its row; what is kept in the checkpoint folder is sums and the words that come often.
    """
    n = S.sums(f, phrases(**lists)[0], A.sizes())
    over = F.lit(None)
    if baseline is not None:
        n = cut(n.withColumn("row", F.monotonically_increasing_id()))
        often = n.select("row", F.explode("often").alias("x"), F.col("content").alias("all")).select("row", "x.word", "x.count", "all")
        found = A.beyond(often, baseline, 3.0, "row").groupBy("row").agg(F.count("*").alias("overused"))
        n, over = n.join(found, "row", "left"), F.col("overused")
    words, sentences = (F.nullif(F.col(c), F.lit(0)) for c in ("words", "sentences"))  # a document without words has no ratios
    some = lambda c: F.when(F.col("words") > 0, c)
    spread = F.sqrt((sentences * F.col("squares") - words * words).cast("double")) / sentences
    lengths = [F.round(words / sentences, 4).alias("mean_sentence_words"), F.round(spread, 4).alias("sentence_stdev"), some(F.col("longest")).alias("sentence_words")]
    diverse = [some(F.col("unique")).alias("unique"), *[c.alias(name) for name, c in I.diverse(words=words).items()]]
    scores = [c.alias(name) for name, c in A.scores(words, sentences, F.col("syllables"), F.col("hard"), F.col("letters")).items()]
    rates = [F.round(T.per_thousand(F.col(f"n_{r}"), F.col("words")), 4).alias(f"{r}_per_1k") for r in RATES]
    runs = [F.col(f"n_{r.replace('-', '_')}").alias(c) for r, c in RUNS.items()]
    out = [*A.counted(), *diverse, *lengths, *scores, F.round(F.col("spoken") / words, 4).alias("dialogue_ratio"), *rates, *runs]
    return n.select("doc_id", *out, F.col("n_cliche").alias("cliches"), F.coalesce(over, F.lit(0)).cast("long").alias("overused"))


SCORES = ("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau", "automated_readability")


def total(table: DataFrame) -> DataFrame:
    """The row of all documents together, from their metrics: sums, rates over all words, scores weighed by words."""
    words = F.sum("words")
    sums = ("words", "characters", "characters_no_space", "sentences", "paragraphs", *RUNS.values(), "cliches")
    mean = lambda c: F.round(F.when(words > 0, F.sum(F.col(c) * F.col("words")) / words).otherwise(0.0) + 1e-9, 3)
    rates = [mean(f"{r}_per_1k").alias(f"{r}_per_1k") for r in RATES]
    return table.agg(*[F.sum(c).cast("long").alias(c) for c in sums], F.max("sentence_words").alias("sentence_words"), *[mean(c).alias(c) for c in (*SCORES, "dialogue_ratio")], *rates)


def tops(f: Frames, words: int = 15, phrases: int = 10, openers: int = 8) -> DataFrame:
    """(kind, item, count): the most frequent content words, repeated phrases of a document and sentence openers."""
    f = f.settled()
    first = lambda df, kind, item, n: df.select(F.lit(kind).alias("kind"), F.col(item).alias("item"), "count").orderBy(F.desc("count"), "item").limit(n)
    return first(A.frequency(f.words, 3), "word", "word", words).unionByName(first(I.repeats(f), "repeat", "phrase", phrases)).unionByName(first(A.starter_counts(f.sentences), "opener", "word", openers))


def limits_table(spark: SparkSession, limits) -> DataFrame:
    return spark.createDataFrame([*limits], "rule string, kind string, limit double, severity string")


def violations(table: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, rule, actual, limit, severity) of every metric beyond its limit; the limits themselves pass."""
    names = [c for c, kind in table.dtypes if kind in ("double", "bigint") and c != "doc_id"]
    long = table.unpivot("doc_id", [F.col(c).cast("double").alias(c) for c in names], "rule", "actual")
    beyond = ((F.col("kind") == "max") & (F.col("actual") > F.col("limit"))) | ((F.col("kind") == "min") & (F.col("actual") < F.col("limit")))
    return long.join(F.broadcast(limits), "rule").filter(beyond).select("doc_id", "rule", "actual", "limit", "severity")  # a configured list of rules


def passed(found: DataFrame) -> DataFrame:
    """(doc_id, passed) of documents with violations: warnings alone pass."""
    return found.groupBy("doc_id").agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def _ranked(f: Frames, each: int, **lists) -> DataFrame:
    """(doc_id, rule, message, sent, pos, rank, hidden) of the first `each` findings of a document and rule that a review ranks."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.REVISION_RANK.items() for x in kv]), F.col("rule")), F.lit(0))
    echo = 100 - F.least("distance", F.lit(50))
    found = S.findings(f, *phrases(**lists), runs=True, echoes=50, each=each)
    return found.select("doc_id", "rule", "message", "sent", "pos", F.when(F.col("rule") == "echo", echo).otherwise(rank).cast("long").alias("rank"), "hidden")


def revisions_by_document(f: Frames, each: int = 3, limit: int = 50, **lists) -> DataFrame:
    """(doc_id, rule, message, sent, pos, rank, nth, of): each document's findings that matter most, as revisions() takes them.

    nth is the place in the document's list, `of` how many findings it has in all.
    """
    ranked = _ranked(f, each, **lists)
    order = [F.desc("rank"), "pos", "message"]
    some = ranked.withColumns({"k": F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy(*order)), "of": F.count("*").over(Window.partitionBy("doc_id")) + F.sum("hidden").over(Window.partitionBy("doc_id"))}).filter(F.col("k") <= each)
    return some.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col("nth") <= limit).drop("k", "hidden")


def revisions(f: Frames, each: int = 3, limit: int = 50, **lists) -> DataFrame:
    """(doc_id, rule, message, sent, pos, rank) of the findings that matter most: up to `each` of a rule, up to `limit` of all.

    Within a rank findings go by document and place. The name of a rule counts, so long sentences and monotony, of one rank,
    have `each` places of their own.
    """
    ranked = _ranked(f, each, **lists)
    order = [F.desc("rank"), "doc_id", "pos", "message"]
    # first the best of each document and rule, so that a rule's whole findings never meet in one task
    local = ranked.withColumn("k", F.row_number().over(Window.partitionBy("rule", "doc_id").orderBy(*order))).filter(F.col("k") <= each)
    part = local.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("k", F.row_number().over(Window.partitionBy("rule", "part").orderBy(*order))).filter(F.col("k") <= each)
    top = part.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy(*order))).filter(F.col("k") <= each)
    return top.orderBy(*order).limit(limit).select("doc_id", "rule", "message", "sent", "pos", "rank")
