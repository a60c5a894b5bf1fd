"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_text

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row are never learnt from: crc32 of the id as text, modulo FOLDS, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


#: Windows that stand for a text too long for the sample.
WINDOWS = 4


def shortened(text: Column, most: int) -> Column:
    """The text, or of one longer than `most` characters WINDOWS even-spaced windows of it, together that long."""
    size = most // WINDOWS
    step = F.floor((F.length(text) - size) / (WINDOWS - 1))
    cut = [F.substring(text, F.lit(1) + (step * k).cast("int"), F.lit(size)) for k in range(WINDOWS)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *cut))


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int], max_chars: int) -> list[tuple[int, str]]:
    """(label, text) of at most per_class[label] documents a label, chosen by the hash of their ids among those with a row.

    Held-out rows and null labels are left out; of a long text only windows are taken (see shortened). An id with several
    labels counts as the largest of them; of several rows with one id the one with the least text counts. The result is
    bounded by per_class and max_chars alone, whatever the input's size.
    """
    known = labels.filter(F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for label, n in sorted(per_class.items()):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select(F.col("doc_id").alias("of"), "label")
    texts = with_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("of"))  # at most sum(per_class) ids
    rows = texts.groupBy("doc_id", "label").agg(F.min(shortened(F.col("text"), max_chars)).alias("text")).collect()
    return [(int(r["label"]), r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
