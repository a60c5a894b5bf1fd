"""Quality rules: compression bands of zstandard ratios over whole documents and fixed chunks, beside base counts.

A text compresses the better the longer it is, so limits depend on length. fit() learns the least ratio from good labelled
documents, all of them: a curve over the logarithm of the length, and how far below it all but one in a hundred of them stay, by half octaves.
Where it knows no lengths, and for the greatest ratio, wide fixed bands hold. Chunks of a document are judged as texts of their
length; what is left after the last whole chunk belongs to that one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .common import SPACES, with_text
from .labelled import held_out
from .streams import through

#: (bytes from, least ratio, most ratio): short texts pay for the frame and the first literals.
DOCUMENT_BANDS = ((0, 0.0, 4.0), (64, 0.30, 1.35), (256, 0.26, 1.05), (1024, 0.22, 0.92), (4096, 0.18, 0.86), (16384, 0.15, 0.82))
#: Bytes of a chunk, and the share of a document's chunks that may lie outside their bands.
CHUNK, CHUNK_SHARE = 2048, 0.34
#: A chunk may compress so much better than a document of its length.
CHUNK_SLACK = 0.01
LEVEL, MIN_WORDS, MAX_REPEATED = 3, 50, 0.5
#: The share of good labelled documents that may lie below the limit, and how many of them a half octave needs.
BELOW, SUPPORT = 0.01, 30
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks long, bad_chunks long, kept boolean"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES.decode())]
    repeated = 0
    if n > 3:
        found = Counter(zip(words, words[1:], words[2:], strict=False))
        if len(found) < n - 2:
            end = 0
            for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
                if found[w] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return n, len(text) - sum(text.count(chr(c)) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


@dataclass(frozen=True)
class Limits:
    """Least ratios by length: a curve over log2 of the bytes, and the distance below it at each knot. None: fixed bands alone."""

    curve: tuple[float, ...] = ()
    knots: tuple[float, ...] = ()
    below: tuple[float, ...] = ()

    def of(self, size: int) -> tuple[float, float]:
        low, high = next(b[1:] for b in reversed(DOCUMENT_BANDS) if size >= b[0])
        at = np.log2(size)
        if self.knots and self.knots[0] - 0.25 <= at <= self.knots[-1] + 0.25:
            low = max(low, float(np.polyval(self.curve, at) + np.interp(at, self.knots, self.below)))
        return low, high


def chunk_ends(size: int) -> list[int]:
    """Where the chunks of so many bytes end; the last one takes the rest."""
    return [*range(CHUNK, size - CHUNK + 1, CHUNK), size]


def bands(data: bytes, compressor, limits: Limits) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks, chunks out of their band, within the bands)."""
    if not data:
        return 0.0, 0, 0, False
    ratio = len(compressor.compress(data)) / len(data)
    low, high = limits.of(len(data))
    ends, start, bad = chunk_ends(len(data)), 0, 0
    for end in ends if len(ends) > 1 else ():
        least, most = limits.of(end - start)
        bad += not least - CHUNK_SLACK <= len(compressor.compress(data[start:end])) / (end - start) <= most
        start = end
    return ratio, len(ends), bad, low <= ratio <= high and bad <= CHUNK_SHARE * len(ends)


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or counts[4] > MAX_REPEATED * counts[0]


#: Distances below the curve are counted in bins so wide, and a limit is the lower end of one.
BIN = 1e-5


def fit(docs: DataFrame, labels: DataFrame) -> Limits:
    """Limits from all good labelled documents that pass the base rules.

    Held-out rows and null labels are not learnt from. Ratios are taken where the texts are, and two numbers a document are kept in
    the checkpoint folder. The curve comes from their sums; of each knot's documents, those within three quarters of an octave, the
    share BELOW is found by counts in bins. Only the sums and a row a knot come to the driver. Fewer than SUPPORT
    documents give the fixed bands.
    """
    good = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()

    def ratios(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for doc_id, text in rows:
            data = text.encode()
            if not base_failed(base_counts(text)):
                yield doc_id, float(np.log2(len(data))), len(compressor.compress(data)) / len(data)

    # narrow rows are joined, not texts, whatever the number of labels
    measured = through(with_text(docs.filter(~held_out(F.col("doc_id")))), ratios, "doc_id long, size double, ratio double")
    found = cut(measured.join(good, "doc_id", "left_semi").select("size", "ratio"))
    middle = 10.0  # powers are taken around the middle, so that their sums keep their digits
    x = F.col("size") - middle
    powers = [F.sum(F.pow(x, F.lit(k))).alias(f"x{k}") for k in range(5)] + [F.sum(F.pow(x, F.lit(k)) * F.col("ratio")).alias(f"y{k}") for k in range(3)]
    sums = found.agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), *powers).first()  # one row
    if sums["n"] < SUPPORT:
        return Limits()
    normal = np.array([[sums[f"x{4 - a - b}"] for b in range(3)] for a in range(3)])
    shifted = np.linalg.lstsq(normal, np.array([sums[f"y{2 - a}"] for a in range(3)]), rcond=None)[0]
    curve = np.polyadd(np.poly1d(shifted)(np.poly1d([1.0, -middle])).coeffs, np.zeros(3)).round(9)  # sums differ in their last digits
    off = F.col("ratio") - (F.lit(float(curve[0])) * F.col("size") * F.col("size") + F.lit(float(curve[1])) * F.col("size") + F.lit(float(curve[2])))
    halves = F.sequence(F.ceil((F.col("size") - 0.75) * 2), F.floor((F.col("size") + 0.75) * 2))
    near = found.select(F.floor(off / BIN).alias("bin"), F.explode(F.transform(halves, lambda k: k / 2)).alias("knot")).filter(F.col("knot").between(float(np.floor(sums["least"])), float(np.ceil(sums["most"]))))
    bins = near.groupBy("knot", "bin").agg(F.count("*").alias("n"))  # at most 1 / BIN and some rows a knot, however many documents
    each = Window.partitionBy("knot")
    bins = bins.withColumn("upto", F.sum("n").over(each.orderBy("bin"))).withColumn("n", F.sum("n").over(each))
    low = bins.filter((F.col("n") >= SUPPORT) & (F.col("upto") > F.floor(BELOW * (F.col("n") - 1)))).groupBy("knot").agg((F.min("bin") * F.lit(BIN)).alias("below"))
    knots = sorted(map(tuple, low.collect()))  # a row a half octave
    return Limits(tuple(map(float, curve)), tuple(k for k, _ in knots), tuple(b for _, b in knots))


def judge(text: str, compressor, limits: Limits) -> tuple:
    """The base counts, whether they fail, ratio, chunks, chunks out of their band, and whether the text is kept."""
    counts = base_counts(text)
    failed = base_failed(counts)
    *found, good = bands(text.encode(), compressor, limits)
    return *counts, failed, *found, good and not failed


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """Base counts, compression ratios and the verdict `kept` of each document, under limits that fit() has learnt.

    A null or empty text has no words, ratio 0 and fails. Repeated rows are judged alike, extra columns are ignored, an
    empty table gives an empty result, and a long text is judged whole, chunk by chunk.
    """

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return ((doc_id, *judge(text, compressor, limits)) for doc_id, text in rows)

    return through(with_text(docs), score, SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """The rows of `docs`, all columns as they are, whose text the rules keep."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([judge(text or "", compressor, limits)[-1] for text in texts], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)
