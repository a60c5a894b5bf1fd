"""Documents as flat frames: sentences, words, headings and dialogue, cut out of the text by expressions inside one row.

Segmentation explodes nothing until the last step and shuffles nothing: each document's arrays are built in its own row, so
every frame keeps the partitioning of its input and only the analyses that need a key exchange rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import markup
from .lineage import cut, dealt


@dataclass(frozen=True)
class Frames:
    """docs: (doc_id, source, prose, paras array<struct<section, text>>, headings array<...>).

    stored is the segmentation if it was settled; together says that docs are dealt out by the hash of doc_id.
    """

    docs: DataFrame
    stored: DataFrame | None = None
    together: bool = False
    parsed: bool = False

    @classmethod
    def plain(cls, docs: DataFrame) -> Frames:
        """Frames of plain texts (doc_id, text): all of it prose, no headings."""
        docs = dealt(docs)
        text = F.coalesce(F.col("text"), F.lit(""))
        paras = F.transform(T.paragraphs(text), lambda p: F.struct(F.lit(None).cast("int").alias("section"), p.alias("text")))
        return cls(docs.select("doc_id", text.alias("source"), text.alias("prose"), paras.alias("paras"), F.lit(None).cast(markup.HEADINGS).alias("headings")), together=True)

    @classmethod
    def marked_up(cls, docs: DataFrame) -> Frames:
        """Frames of texts (doc_id, format, source); Markdown and screenplays go through the parser, row by row."""
        raw = dealt(docs.select("doc_id", "format", F.coalesce("source", F.lit("")).alias("source")))
        return cls(raw.mapInArrow(markup.parse_batches, markup.SCHEMA), parsed=True)

    def settled(self) -> Frames:
        """The same frames with their segmentation kept in the checkpoint folder, dealt out by document.

        Texts move once, before they are cut into words. Each analysis reads the segmentation instead of cutting anew, and
        what it does by document (windows, joins, groups) needs no further exchange.
        """
        if self.stored is not None:
            return self
        docs = self.docs
        if not self.together:
            docs = dealt(docs)
        if self.parsed:
            docs = cut(docs, True)
        return Frames(docs, cut(Frames(docs).cut, True), True, self.parsed)

    @property
    def cut(self) -> DataFrame:
        """(doc_id, prose, paras, sents array<struct<para, section, text, words>>): sentences without words are gone, as are empty paragraphs."""
        if self.stored is not None:
            return self.stored
        spoken = T.has_speech(F.col("prose"))
        paras = F.transform("paras", lambda p: F.struct(p["section"].alias("section"), F.when(spoken, T.mark_speech(p["text"])).otherwise(p["text"]).alias("text")))
        cut = F.transform(paras, lambda p: F.struct(p["section"].alias("section"), F.filter(F.transform(T.sentences(p["text"]), lambda s: F.struct(s.alias("text"), T.words(s).alias("words"))), lambda s: F.size(s["words"]) > 0).alias("sents")))
        full = F.filter(cut, lambda p: F.size(p["sents"]) > 0)
        flat = F.flatten(F.transform(full, lambda p, i: F.transform(p["sents"], lambda s: F.struct(i.alias("para"), p["section"].alias("section"), s["text"].alias("text"), s["words"].alias("words")))))
        return self.docs.select("doc_id", "prose", "paras", flat.alias("sents"))

    @property
    def sentences(self) -> DataFrame:
        """(doc_id, para, section, sent, text, words, n_words, first_word, first); first is its first word's place in the document."""
        # an inner explode has Catalyst test its array for emptiness below all exchanges, which would cut every text once more
        one = self.cut.select("doc_id", F.posexplode_outer("sents").alias("sent", "s")).filter("s IS NOT NULL").select("doc_id", "s.*", "sent", F.size("s.words").alias("n_words"))
        before = Window.partitionBy("doc_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
        plain = F.when(F.col("text").contains(T.SPOKEN), F.transform("words", T.unmarked)).otherwise(F.col("words"))
        out = one.select("doc_id", "para", "section", "sent", T.unmarked(F.col("text")).alias("text"), plain.alias("words"), "n_words", F.coalesce(F.sum("n_words").over(before), F.lit(0)).cast("long").alias("first"))
        return out.withColumn("first_word", T.fold(F.element_at("words", 1)))

    @property
    def words(self) -> DataFrame:
        """(doc_id, para, section, sent, pos, w_in_sent, raw, lower, in_dialogue); pos counts the document's words from 0."""
        each = F.transform("sents", lambda s, i: F.transform(s["words"], lambda w, j: F.struct(s["para"].alias("para"), s["section"].alias("section"), i.alias("sent"), j.alias("w_in_sent"), w.alias("w"))))
        one = self.cut.select("doc_id", F.posexplode_outer(F.flatten(each)).alias("pos", "x")).filter("x IS NOT NULL")
        out = one.select("doc_id", "x.para", "x.section", "x.sent", "pos", "x.w_in_sent", T.unmarked(F.col("x.w")).alias("raw"), F.col("x.w").startswith(T.SPOKEN).alias("in_dialogue"))
        return out.withColumn("lower", T.fold(F.col("raw")))

    @property
    def headings(self) -> DataFrame:
        """(doc_id, section, level, title, line)."""
        return self.docs.select("doc_id", F.posexplode("headings").alias("section", "h")).select("doc_id", "section", "h.level", "h.title", "h.line")
