"""Series along a text: a row a sentence, and points that each stand for an even share of a section's sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import Frames


def sentence_series(f: Frames, findings: DataFrame) -> DataFrame:
    """(doc_id, section, sent, para, words, first_word, paragraph_words, dialogue_words, findings, variation).

    Words count from 1 in the document. Variation is the population deviation of the lengths of up to five sentences, the
    last one this, none before the section, in percent of their mean. findings: (doc_id, sent, ...).
    """
    n = f.words.groupBy("doc_id", "section", "para", "sent").agg(F.count("*").alias("words"), F.count_if("in_dialogue").alias("dialogue_words"))
    hits = findings.groupBy("doc_id", F.col("sent").cast("int").alias("sent")).agg(F.count("*").alias("findings"))
    w = Window.partitionBy("doc_id").orderBy("sent")
    near = Window.partitionBy("doc_id", "section").orderBy("sent").rowsBetween(-4, 0)
    out = n.join(hits, ["doc_id", "sent"], "left").withColumn("first_word", F.sum("words").over(w) - F.col("words") + 1)
    out = out.withColumn("paragraph_words", F.sum("words").over(Window.partitionBy("doc_id", "para")))
    out = out.withColumn("variation", F.stddev_pop("words").over(near) * 100 / F.avg("words").over(near))
    return out.select("doc_id", F.coalesce("section", F.lit(-1)).cast("long").alias("section"), F.col("sent").cast("long").alias("sent"), F.col("para").cast("long").alias("para"), "words", "first_word", "paragraph_words", "dialogue_words", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.round(F.col("variation") + 1e-9, 4).alias("variation"))


def points(series: DataFrame, most: int = 512) -> DataFrame:
    """Up to `most` points a section: consecutive sentences in even groups, the first groups one larger where need be."""
    w = Window.partitionBy("doc_id", "section").orderBy("sent")
    grouped = series.withColumn("point", F.ntile(most).over(w)).withColumn("opens", F.when(F.row_number().over(Window.partitionBy("doc_id", "section", "point", "para").orderBy("sent")) == 1, F.col("paragraph_words")))
    n = grouped.groupBy("doc_id", "section", F.col("point").cast("long").alias("point")).agg(F.min("sent").alias("first_sentence"), F.max("sent").alias("last_sentence"), F.min("first_word").alias("first_word"), F.sum("words").alias("words"), F.count("*").alias("sentences"), F.sum("opens").alias("p_words"), F.count("opens").alias("paragraphs"), F.sum("dialogue_words").alias("said"), F.sum("findings").alias("findings"), F.sum("variation").alias("variation"))
    rounded = lambda c: F.round(c + 1e-9, 4)
    return n.select("doc_id", "section", "point", "first_sentence", "last_sentence", "first_word", "words", rounded(F.col("words") / F.col("sentences")).alias("sentence_length"), rounded(F.col("p_words") / F.col("paragraphs")).alias("paragraph_length"), rounded(F.col("said") * 100.0 / F.col("words")).alias("dialogue_share"), rounded(F.col("findings") * 1000.0 / F.col("words")).alias("finding_density"), rounded(F.col("variation") / F.col("sentences")).alias("sentence_variation"))


#: Points of a chart, targets of its resolutions, and the most chapters for which chapters are shown by themselves.
MAX_POINTS, TARGETS, CHAPTERS = 8192, {"chapter": (4, 8, 16), "overview": (128, 256, 512)}, 1024


def _share(i, n, target: int):
    """The group of row i of n, of `target` even groups (a row each if there are fewer), the first ones larger by one."""
    size, extra = F.floor(n / target), n % target
    large = extra * (size + 1)
    return F.when(n <= target, i).when(i < large, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - large) / F.greatest(size, F.lit(1)))).cast("long")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Points from sentences by keys: sums by paragraph first, then over paragraphs, each with its whole length once a point."""
    counted = ("words", "dialogue_words", "findings", "variation", "n")
    some = rows.withColumns({"last_word": F.col("first_word") + F.col("words") - 1, "n": F.lit(1).cast("long")})
    parts = some.groupBy(*keys, "para").agg(F.min("sent").alias("first_sentence"), F.max("sent").alias("last_sentence"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), *[F.sum(c).alias(c) for c in counted], F.max("paragraph_words").alias("paragraph_words"))
    merged = [(F.min, "first_sentence"), (F.max, "last_sentence"), (F.min, "first_word"), (F.max, "last_word")]
    out = parts.groupBy(*keys).agg(*[f(c).alias(c) for f, c in merged], F.min("para").alias("first_paragraph"), F.max("para").alias("last_paragraph"), *[F.sum(c).alias(c) for c in counted], F.avg("paragraph_words").alias("paragraph_length"))
    rounded = lambda c, name: F.round(c + 1e-9, 4).alias(name)
    places = ("first_sentence", "last_sentence", "first_word", "last_word", "first_paragraph", "last_paragraph", "words")
    w = F.col("words")
    return out.select(*keys, *places, rounded(w / F.col("n"), "sentence_length"), rounded(F.col("paragraph_length"), "paragraph_length"), rounded(F.col("dialogue_words") * 100.0 / w, "dialogue_share"), rounded(F.col("findings") * 1000.0 / w, "finding_density"), rounded(F.col("variation") / F.col("n"), "sentence_variation"))


def resolutions(series: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """Points of a document at all resolutions: (doc_id, resolution, target, section, point, ..., automatic).

    `overview` shares a document's sentences evenly among 128, 256 and 512 points, `chapter` each section's among 4, 8 and 16 where
    there are two sections or more (section -1 is what stands before the first). Sentences are counted in their document and
    section once, go to the six groups they belong to, and are summed up in one exchange. A resolution of over `most` points is
    left out. `automatic` marks the one that is shown by default: eight points a chapter, of up to CHAPTERS, or else 256 in all.
    """
    by_doc, by_section = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "section")
    rows = series.withColumns({"i": F.row_number().over(by_doc.orderBy("sent")) - 1, "n_all": F.count("*").over(by_doc), "j": F.row_number().over(by_section.orderBy("sent")) - 1, "m": F.count("*").over(by_section)})
    rows = rows.withColumn("sections", F.sum((F.col("j") == 0).cast("int")).over(by_doc))
    group = lambda kind, t, section, point: F.struct(F.lit(kind).alias("resolution"), F.lit(t).cast("long").alias("target"), section.cast("long").alias("part"), point.alias("point"))
    wide = [group("overview", t, F.lit(None), _share(F.col("i"), F.col("n_all"), t)) for t in TARGETS["overview"]]
    close = [group("chapter", t, F.col("section"), _share(F.col("j"), F.col("m"), t)) for t in TARGETS["chapter"]]
    each = rows.withColumn("g", F.explode(F.concat(F.array(*wide), F.when(F.col("sections") >= 2, F.array(*close)).otherwise(F.array().cast("array<struct<resolution:string,target:bigint,part:bigint,point:bigint>>")))))
    found = _summed(each.select(*series.columns, "sections", "g.*"), "doc_id", "sections", "resolution", "target", "part", "point")
    fits = found.withColumn("points", F.count("*").over(Window.partitionBy("doc_id", "resolution", "target"))).filter(F.col("points") <= most)
    chaptered = F.col("sections").between(2, CHAPTERS)
    automatic = F.when(chaptered, (F.col("resolution") == "chapter") & (F.col("target") == 8)).otherwise((F.col("resolution") == "overview") & (F.col("target") == 256))
    return fits.withColumn("automatic", automatic).drop("points", "sections").withColumnRenamed("part", "section")


def visible_points(series: DataFrame, views: DataFrame, resolution: str = "sentence", most: int = MAX_POINTS) -> DataFrame:
    """Points of the sentences first to last of views (doc_id, first, last): a point a sentence, or a whole paragraph each.

    A view of over `most` points has none: a coarser resolution or a smaller view is asked for.
    """
    if resolution not in ("sentence", "paragraph"):
        raise ValueError("choose sentence or paragraph")
    inside = series.join(views, "doc_id").filter((F.col("sent") >= F.col("first")) & (F.col("sent") <= F.col("last")))
    if resolution == "paragraph":
        touched = inside.select("doc_id", "first", "last", "para").distinct()
        inside = series.join(touched, ["doc_id", "para"])
    key = "sent" if resolution == "sentence" else "para"
    found = _summed(inside.withColumn("point", F.col(key)), "doc_id", "first", "last", "point")
    return found.withColumn("points", F.count("*").over(Window.partitionBy("doc_id", "first", "last"))).filter(F.col("points") <= most).drop("points")


def chapters(f: Frames) -> DataFrame:
    """(doc_id, section, title) of chapters: headings labelled as such if two or more are, else those of the first level used twice."""
    heads = f.headings.select("doc_id", F.col("section").cast("long").alias("section"), "level", "title", T.is_chapter_label(F.col("title")).alias("labelled"))
    named = heads.groupBy("doc_id").agg(F.count_if("labelled").alias("labels"))
    level = heads.groupBy("doc_id", "level").count().filter("count >= 2").groupBy("doc_id").agg(F.min("level").alias("of_level"))
    both = heads.join(named, "doc_id").join(level, "doc_id", "left")
    return both.filter(F.when(F.col("labels") >= 2, F.col("labelled")).otherwise(F.col("level") == F.col("of_level"))).select("doc_id", "section", "title")


def sparkline(series: DataFrame, value: str, order: str) -> DataFrame:
    """(doc_id, line): a document's values as eight levels of blocks, from the least to the greatest."""
    levels = F.array(*[F.lit(x) for x in "▁▂▃▄▅▆▇█"])
    n = series.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    n = n.withColumn("lo", F.array_min(F.transform("s", lambda x: x["v"]))).withColumn("hi", F.array_max(F.transform("s", lambda x: x["v"])))
    level = lambda v: F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 8) + 1, F.lit(8))).cast("int")
    return n.select("doc_id", F.array_join(F.transform("s", lambda x: F.element_at(levels, level(x["v"]))), "").alias("line"))
