"""Readings by a language model over a whole corpus: a ledger of facts, voices of speakers, scenes with verdicts.

No client is part of the library: `ask` is any function from a prompt to the model's reply, JSON in the shape that each reading
names. It runs on the executors, once a batch, so it must be picklable and may be called again for a batch whose executor is
lost. Texts go out as numbered lines in batches that one request can hold; what a reply cites is pinned to the source for all
replies at once, and what it gets wrong (indices, documents, verdicts, missing fields) is dropped or marked, never trusted. A
reply that is not JSON gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import analyses as A
from . import evidence as E
from .frames import Frames
from .lineage import cut
from .located import word_places

Ask = Callable[[str], str]
#: Verdicts on a scene.
SCENE_VERDICTS = ("keep", "tighten", "cut", "merge")
FACTS = "facts array<struct<entity:string,attribute:string,value:string,file:string,line:long,quote:string>>, contradictions array<struct<entity:string,attribute:string,facts:array<long>,note:string>>"
VOICES = "characters array<struct<name:string,lines:long,profile:string>>, findings array<struct<character:string,file:string,line:long,quote:string,note:string>>"
SCENES = "scenes array<struct<title:string,file:string,line:long,last:long,opening:string,goal:string,conflict:string,change:string,verdict:string,note:string>>"


def lines_of(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, line, piece, text): numbered lines, one of over half of `most` bytes in pieces that carry the same number."""
    lines = E.numbered(docs.filter("doc_id IS NOT NULL"))
    size = max(most // 8, 1)  # characters, of up to four bytes each
    head = F.concat(F.col("doc_id"), F.lit(":"), F.col("line"), F.lit("| "))
    rest = F.substr("numbered", F.length(head) + 1)
    cut_up = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(rest) / size) - 1, F.lit(0)).cast("int")), lambda k: F.concat(head, F.substr(rest, k * size + 1, F.lit(size))))
    pieces = F.when(F.octet_length("numbered") + 1 <= most // 2, F.array("numbered")).otherwise(cut_up)
    return lines.select("doc_id", "line", F.posexplode(pieces).alias("piece", "text"))


def batches(docs: DataFrame, most: int = E.MAX_PROMPT_BYTES, *keys: str) -> DataFrame:
    """(keys..., batch, text): the numbered lines of documents (doc_id, text) in turn, at most `most` bytes together.

    Batches are cut by running sums of bytes: a line belongs to the batch in whose half of `most` it starts, and no line is
    longer than the other half. Sums run over documents first, one narrow row each, and over a document's lines then. keys are
    columns of docs, by whose values batches stay apart. Documents without an id are left out.
    """
    lines = lines_of(docs.select("doc_id", "text"), most).withColumn("bytes", (F.octet_length("text") + 1).cast("long"))
    per_doc = lines.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).join(docs.select("doc_id", *keys).distinct(), "doc_id") if keys else lines.groupBy("doc_id").agg(F.sum("bytes").alias("bytes"))
    starts = _running(per_doc, "bytes", keys)
    inside = Window.partitionBy("doc_id").orderBy("line", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(starts.drop("bytes"), "doc_id").withColumn("at", F.col("start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    numbered = placed.withColumn("batch", F.floor(F.col("at") / (most // 2)).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "line", "piece", "text")))
    return numbered.groupBy(*keys, "batch").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def _running(per_doc: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """per_doc with `start`: the sum of `value` over the documents before, of equal keys if there are any.

    Without keys rows are dealt out by ranges and the sums of whole partitions, one row each, are added; no window holds all.
    """
    before = lambda *part: Window.partitionBy(*part).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda *part: F.coalesce(F.sum(value).over(before(*part)), F.lit(0)).cast("long")
    if keys:
        return per_doc.withColumn("start", sums(*keys))
    dealt = cut(per_doc.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()))
    offsets, total = [], 0
    for part, size in sorted(map(tuple, dealt.groupBy("part").agg(F.sum(value)).collect())):  # one row a partition
        offsets.append((part, total))
        total += size
    known = dealt.sparkSession.createDataFrame(offsets, "part int, base long")
    return dealt.join(F.broadcast(known), "part").withColumn("start", F.col("base") + sums("part")).drop("part", "base")


def replies(found: DataFrame, ask: Ask, intro: str, shape: str, *keys: str) -> DataFrame:
    """(keys..., batch, reply) of each batch; the model is asked on the executors, and the replies are kept, so none is asked twice."""
    columns = [*keys, "batch"]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", reply string"

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield page[columns].assign(reply=[ask(f"{intro}\n\n{text}") for text in page["text"]])

    asked = cut(found.select(*columns, "text").mapInPandas(run, ddl))
    return asked.select(*columns, F.from_json("reply", shape).alias("reply")).filter("reply IS NOT NULL")


def _each(found: DataFrame, column: str, index: str, *keys: str) -> DataFrame:
    return found.select(*keys, "batch", F.posexplode(f"reply.{column}").alias(index, "x")).filter("x IS NOT NULL").select(*keys, "batch", F.col(index).cast("long").alias(index), "x.*")


def _cited(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with doc_id in place of `file`, of the kind that docs has; null where it can't be one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.withColumn("doc_id", F.expr(f"try_cast(file AS {kind})")).drop("file")


class Ledger:
    """Facts, contradictions and conflicts of documents (doc_id, text[, keys])."""

    INTRO = "Build a ledger of the concrete facts in this text, each with a quote, and say which of them can't all be true."

    def __init__(self, docs: DataFrame, ask: Ask, *keys: str, most: int = E.MAX_PROMPT_BYTES) -> None:
        self.docs, self.keys = docs, keys
        self.replies = replies(batches(docs, most, *keys), ask, self.INTRO, FACTS, *keys)

    def facts(self) -> DataFrame:
        """(keys..., batch, fact, entity, attribute, value, doc_id, line, column, verified, quote): every fact, pinned to its source."""
        cited = _cited(_each(self.replies, "facts", "fact", *self.keys), self.docs)
        found = E.pins(self.docs, cited)
        return found.select(*self.keys, "batch", "fact", "entity", "attribute", "value", "doc_id", F.col("at_line").alias("line"), "column", "verified", "quote")

    def contradictions(self) -> DataFrame:
        """(keys..., batch, number, entity, attribute, facts, note): indices of facts that there are; two at least must be left."""
        found = _each(self.replies, "contradictions", "number", *self.keys)
        known = self.replies.select(*self.keys, "batch", F.coalesce(F.size("reply.facts"), F.lit(0)).alias("known"))
        both = found.join(known, [*self.keys, "batch"]).withColumn("facts", F.filter("facts", lambda i: (i >= 0) & (i < F.col("known"))))
        return both.filter(F.size("facts") >= 2).select(*self.keys, "batch", "number", "entity", "attribute", "facts", "note")

    def conflicts(self) -> DataFrame:
        """(keys..., entity, attribute, value, facts, doc_id, line): values of one attribute that differ, over all batches.

        A row a value, with its number of facts and its first place, instead of pairs of facts; names, attributes and values
        are compared without case and outer white space. Values count by key, so facts of a frequent entity are added up before
        they meet.
        """
        plain = lambda c: F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))).alias(c)
        each = self.facts().select(*self.keys, plain("entity"), plain("attribute"), plain("value"), F.struct("doc_id", "line").alias("place"))
        values = each.groupBy(*self.keys, "entity", "attribute", "value").agg(F.count("*").alias("facts"), F.min("place").alias("place"))
        several = values.groupBy(*self.keys, "entity", "attribute").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        return values.join(several, [*self.keys, "entity", "attribute"], "left_semi").select(*self.keys, "entity", "attribute", "value", "facts", "place.doc_id", "place.line")


def sampled_lines(said: DataFrame, most: int = 200) -> DataFrame:
    """Up to `most` stretches of dialogue (doc_id, para, nth, said, speaker) of each speaker, by a hash of their place.

    A bound on evidence, stated by its parameter: the same lines whatever the partitions. Each task keeps its first `most` of a
    speaker before they meet, so a speaker of a third of all lines is no large group.
    """
    drawn = said.filter("speaker IS NOT NULL").withColumn("draw", F.md5(F.concat_ws(":", "doc_id", "para", "nth")))
    part = Window.partitionBy("speaker", "part").orderBy("draw", "doc_id", "para", "nth")
    early = drawn.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("k", F.row_number().over(part)).filter(F.col("k") <= most)
    return early.withColumn("k", F.row_number().over(Window.partitionBy("speaker").orderBy("draw", "doc_id", "para", "nth"))).filter(F.col("k") <= most).drop("draw", "part")


class Voices:
    """Profiles of speakers and lines that don't sound like them, from a bounded sample of each speaker's dialogue.

    said: stretches of dialogue with their speakers (attributions); lines: (doc_id, para, line), where paragraphs begin.
    """

    INTRO = "Describe how each speaker talks, from these lines, and flag lines that don't sound like their speaker."

    def __init__(self, docs: DataFrame, said: DataFrame, lines: DataFrame, ask: Ask, most: int = E.MAX_PROMPT_BYTES, sample: int = 200) -> None:
        self.docs = docs
        some = sampled_lines(said, sample).join(lines, ["doc_id", "para"], "left").select("speaker", "k", "doc_id", F.coalesce("line", F.lit(1)).alias("line"), "said")
        text = F.concat(F.col("doc_id"), F.lit(":"), F.col("line"), F.lit("| "), F.col("speaker"), F.lit(": "), F.regexp_replace("said", r"\s+", " "))
        each = some.groupBy("speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
        # speakers of one batch are those whose texts start in the same part of the running sum
        sized = each.withColumn("doc_id", F.col("speaker")).withColumn("bytes", (F.octet_length("text") + 1).cast("long"))
        half = max(most // 2, 1)
        whole = _running(sized.select("doc_id", "bytes"), "bytes", ()).withColumn("batch", F.floor(F.col("start") / half).cast("long"))
        grouped = sized.drop("bytes").join(whole.select("doc_id", "batch"), "doc_id").groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speaker", "text"))), lambda x: x["text"]), "\n").alias("text"))
        self.replies = replies(grouped, ask, self.INTRO, VOICES)

    def profiles(self) -> DataFrame:
        """(name, lines, profile): most lines first, then by name. A name that several batches describe has the profile with most lines."""
        each = _each(self.replies, "characters", "number")
        n = F.coalesce("lines", F.lit(0))
        best = each.groupBy("name").agg(F.sum(n).alias("lines"), F.min_by("profile", F.struct(-n, "batch", "number")).alias("profile"))
        return best.orderBy(F.desc("lines"), "name")

    def findings(self) -> DataFrame:
        """(character, doc_id, line, column, verified, quote, note): flagged lines, pinned to the source."""
        found = E.pins(self.docs, _cited(_each(self.replies, "findings", "number"), self.docs))
        return found.select("character", "doc_id", F.col("at_line").alias("line"), "column", "verified", "quote", "note")


def tiles(scenes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, tile, first, last, ...): a document's lines (doc_id, lines) divided among claimed scenes (doc_id, line, last, title, ...).

    A claim is clipped to the document and to where the next one starts; of claims with one first line the longest counts, then
    the first by title. Lines that none claims are tiles of their own, without a title, so that tiles follow one another from
    the first line to the last. A claim without a last line runs to the next one. One outside the document is dropped.
    """
    more = [c for c in scenes.columns if c not in ("doc_id", "line", "last")]
    claims = scenes.join(lengths, "doc_id").filter((F.coalesce("line", F.lit(1)) <= F.col("lines")) & F.coalesce(F.col("last") >= F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)), F.lit(True)))
    claims = claims.withColumn("first", F.greatest(F.coalesce("line", F.lit(1)), F.lit(1))).withColumn("until", F.least(F.coalesce("last", "lines"), "lines"))
    one = claims.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "first").orderBy(F.desc("until"), *more))).filter("k = 1")
    turn = Window.partitionBy("doc_id").orderBy("first")
    one = one.withColumn("next", F.lead("first").over(turn)).withColumn("until", F.least("until", F.coalesce(F.col("next") - 1, "lines")))
    gap = F.struct((F.col("until") + 1).alias("first"), F.coalesce(F.col("next") - 1, "lines").alias("last"), F.lit(False).alias("claimed"))
    own = F.struct(F.col("first"), F.col("until").alias("last"), F.lit(True).alias("claimed"))
    head = F.struct(F.lit(1).cast("long").alias("first"), (F.col("first") - 1).alias("last"), F.lit(False).alias("claimed"))
    is_first = F.row_number().over(turn) == 1
    laid = one.withColumn("opens", is_first).select("doc_id", *more, F.explode(F.array_compact(F.array(F.when(F.col("opens"), head), own, gap))).alias("t")).filter("t.first <= t.last")
    bare = lengths.join(one.select("doc_id"), "doc_id", "left_anti").filter("lines > 0").select("doc_id", *[F.lit(None).cast(scenes.schema[c].dataType).alias(c) for c in more], F.struct(F.lit(1).cast("long").alias("first"), F.col("lines").cast("long").alias("last"), F.lit(False).alias("claimed")).alias("t"))
    every = laid.unionByName(bare).select("doc_id", F.col("t.first").cast("long").alias("first"), F.col("t.last").cast("long").alias("last"), *[F.when(F.col("t.claimed"), F.col(c)).alias(c) for c in more])
    return every.withColumn("tile", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long"))


def line_numbers(f: Frames) -> DataFrame:
    """(doc_id, line, words, said, sentences, adverbs) of each line with words: what a range of lines adds up."""
    at = word_places(f).select("doc_id", "pos", "line")
    w = f.words.select("doc_id", F.col("pos").cast("long").alias("pos"), "in_dialogue", "w_in_sent", "lower")
    adverb = A.T.is_adverb_shape(F.col("lower")) & ~A.T.one_of(F.col("lower"), A.V.NOT_ADVERBS)
    return w.join(at, ["doc_id", "pos"]).groupBy("doc_id", "line").agg(F.count("*").alias("words"), F.count_if("in_dialogue").alias("said"), F.count_if(F.col("w_in_sent") == 0).alias("sentences"), F.count_if(adverb).alias("adverbs"))


def with_pacing(tiled: DataFrame, numbers: DataFrame) -> DataFrame:
    """Tiles with the words, dialogue share, mean sentence length and adverbs of their lines.

    Each line finds its tile by a running last value over both in turn, so no range is joined.
    """
    both = tiled.select("doc_id", F.col("first").alias("line"), F.lit(0).alias("kind"), "tile", *[F.lit(None).cast("long").alias(c) for c in ("words", "said", "sentences", "adverbs")])
    both = both.unionByName(numbers.select("doc_id", "line", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("tile"), "words", "said", "sentences", "adverbs"))
    held = both.withColumn("tile", F.last("tile", True).over(Window.partitionBy("doc_id").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 1")
    sums = held.groupBy("doc_id", "tile").agg(*[F.sum(c).alias(c) for c in ("words", "said", "sentences", "adverbs")])
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ratio = lambda a, b: F.round(F.when(n(b) > 0, n(a) / n(b)).otherwise(0.0), 4)
    return tiled.join(sums, ["doc_id", "tile"], "left").select(*tiled.columns, n("words").alias("words"), ratio("said", "words").alias("dialogue_ratio"), ratio("words", "sentences").alias("mean_sentence_words"), n("adverbs").alias("adverbs"))


def scenes(f: Frames, docs: DataFrame, ask: Ask, most: int = E.MAX_PROMPT_BYTES) -> DataFrame:
    """(doc_id, first, last, title, goal, conflict, change, verdict, note, verified, tile, words, ...) of documents (doc_id, text).

    The model is shown numbered lines and names scenes by their first line and opening words, and their last line if it likes.
    Openings are pinned to the source, ranges tiled, and each tile measured. Verdicts other than the fixed ones become null.
    """
    found = E.pins(docs, _cited(_each(replies(batches(docs, most), ask, "Split this text into scenes and judge each.", SCENES), "scenes", "number").withColumnRenamed("opening", "quote"), docs))
    verdict = F.when(A.T.one_of(F.col("verdict"), SCENE_VERDICTS), F.col("verdict")).alias("verdict")
    claims = found.select("doc_id", F.col("at_line").alias("line"), "last", "title", "goal", "conflict", "change", verdict, "note", "verified")
    lengths = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("lines"))
    return with_pacing(tiles(claims, lengths), line_numbers(f.settled()))
