"""Findings with their places: lines and columns, excerpts, editor diagnostics, and the rows of a view on a part of a text."""

from __future__ import annotations

from collections.abc import Iterable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import inside as I
from . import scanned as S
from .frames import Frames
from .report import phrases


def word_places(f: Frames) -> DataFrame:
    """(doc_id, pos, start, line, column, unit, units, length) of each word of the prose.

    Places are running sums over a document's alternating gaps and words: start, line and column count characters (lines and
    columns from 1), unit and units count UTF-16 units from the line's start. One exchange, by document. In marked-up texts
    places are those of the source: a mark that is masked takes its own characters and units.
    """
    one = f.docs.select("doc_id", F.posexplode(T.split_words(F.col("prose"))).alias("i", "piece"))
    tail = F.substring_index("piece", "\n", -1)  # what follows the last line end
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("i")
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    is_word = (F.col("i") % 2 == 1) & F.col("piece").rlike(r"\p{IsAlphabetic}")
    out = one.select("doc_id", "i", "piece", before(F.length("piece")).alias("start"), before(T.utf16_length(F.col("piece"))).alias("at16"), (before(F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))) + 1).alias("line"), is_word.alias("is_word"), F.col("piece").contains("\n").alias("breaks"), F.length(tail).alias("tail"), T.utf16_length(tail).alias("tail16"))
    line_start = lambda here, size, rest: F.coalesce(F.max(F.when(F.col("breaks"), here + size - rest)).over(upto), F.lit(0))
    out = out.withColumn("line_start", line_start(F.col("start"), F.length("piece"), F.col("tail"))).withColumn("line16", line_start(F.col("at16"), T.utf16_length(F.col("piece")), F.col("tail16")))
    out = out.withColumn("pos", F.sum(F.col("is_word").cast("int")).over(upto) - 1).filter("is_word")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("line").cast("long").alias("line"), (F.col("start") - F.col("line_start") + 1).cast("long").alias("column"), (F.col("at16") - F.col("line16")).cast("long").alias("unit"), T.utf16_length(F.col("piece")).cast("long").alias("units"), F.length("piece").cast("long").alias("length"))


def spans(f: Frames, window: int = 50, **lists) -> DataFrame:
    """(doc_id, rule, message, pos, n) of all list findings, passives and echoes, pos being the first word's in the document."""
    again = F.concat(F.col("message"), F.lit(" again after "), F.col("distance"), F.lit(" words"))
    found = S.findings(f, *phrases(**lists), echoes=window)
    return found.select("doc_id", "rule", F.when(F.col("rule") == "echo", again).otherwise(F.col("message")).alias("message"), "pos", "n")


def located(f: Frames, most: int = 160, **lists) -> DataFrame:
    """(doc_id, rule, message, line, column, end_line, end_column, text) of all findings; text is an excerpt of the sentence."""
    f = f.settled()
    return I.located(f, spans(f, **lists), most).select("doc_id", "rule", "message", "line", "column", "end_line", "end_column", "text")


def placed(f: Frames, found: DataFrame, most: int = 160) -> DataFrame:
    """Findings (doc_id, pos, sent, ...) with the line and column of their first word and an excerpt of its sentence."""
    f = f.settled()
    at = I.located(f, found.withColumn("n", F.lit(1).cast("long")), most)
    return at.drop("n", "unit", "end_line", "end_column", "end_unit")


def location(name: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", name, line.cast("string"), column.cast("string"))


def diagnostics(f: Frames, **lists) -> DataFrame:
    """Findings as an editor takes them: lines from 0, characters in UTF-16 units, severity 3 (information), code = rule."""
    f = f.settled()
    out = I.located(f, spans(f, **lists))
    return out.select("doc_id", (F.col("line") - 1).alias("line"), F.col("unit").alias("character"), (F.col("end_line") - 1).alias("end_line"), F.col("end_unit").alias("end_character"), F.lit(3).alias("severity"), F.col("rule").alias("code"), "message")


def visible(found: DataFrame, first: int, last: int, rules: Iterable[str] | None = None, most: int = 1000) -> DataFrame:
    """Up to `most` located findings of each document that touch lines first to last, of some rules alone if named."""
    kept = found.filter((F.col("line") <= last) & (F.col("end_line") >= first))
    if rules is not None:
        kept = kept.filter(T.one_of(F.col("rule"), rules))
    w = Window.partitionBy("doc_id").orderBy("line", "column", "rule", "message")
    return kept.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
