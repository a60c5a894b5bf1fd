"""A view on part of a text: an index of findings by line, so that a view reads the rows that overlap it and few others.

Findings are kept as Parquet in order of document and line, with the bucket of lines in which they begin. A small table says for
each bucket how far the findings up to it reach (the running maximum of their ends): the first bucket that reaches a view's first
line is where its reading begins, however long the findings are, and its last line's bucket is where it ends.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines of a bucket, and findings that one view shows.
LINES, MOST = 128, 1000
PLACE = ("line", "column", "end_line", "end_column")


def without_repeats(found: DataFrame) -> DataFrame:
    """Located findings of which none share document, rule and place: the first by message stays."""
    rest = [c for c in found.columns if c not in ("doc_id", "rule", *PLACE)]
    one = found.groupBy("doc_id", "rule", *PLACE).agg(F.min(F.struct("message", *[c for c in rest if c != "message"])).alias("x"))
    return one.select(*[F.col("x")[c].alias(c) if c in rest else F.col(c) for c in found.columns])


def rule_counts(found: DataFrame, *keys: str) -> DataFrame:
    """(keys..., rule, count): findings by rule, of each document by default."""
    return found.groupBy(*(keys or ("doc_id",)), "rule").agg(F.count("*").alias("count"))


class Viewport:
    """The index of located findings (doc_id, rule, message, line, column, end_line, end_column, ...) in a folder."""

    def __init__(self, spark: SparkSession, folder: str, lines: int = LINES) -> None:
        self.spark, self.folder, self.lines = spark, folder.rstrip("/"), lines

    def build(self, found: DataFrame) -> Viewport:
        """Writes the index. Findings without a place or a document are left out; repeated ones count once."""
        sound = without_repeats(found.filter("doc_id IS NOT NULL AND line IS NOT NULL")).withColumn("end_line", F.greatest("line", F.coalesce("end_line", "line")))
        rows = sound.withColumn("bucket", F.floor(F.col("line") / self.lines).cast("long"))
        rows.repartitionByRange("doc_id", "bucket").sortWithinPartitions("doc_id", "bucket", "line", "column").write.parquet(f"{self.folder}/findings")
        upto = Window.partitionBy("doc_id").orderBy("bucket")
        ends = self.findings().groupBy("doc_id", "bucket").agg(F.max("end_line").alias("end"), F.count("*").alias("count"))
        reach = ends.withColumn("reach", F.max("end").over(upto)).drop("end")
        reach.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "bucket").write.parquet(f"{self.folder}/reach")
        return self

    def findings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/findings")

    def reach(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/reach")

    def overlapping(self, doc_id: int, first: int, last: int) -> DataFrame:
        """All findings of one document that touch lines first to last. Bounds of buckets reach the scan as literals."""
        begins = self.reach().filter((F.col("doc_id") == doc_id) & (F.col("reach") >= first)).agg(F.min("bucket")).first()[0]
        if begins is None:
            return self.findings().limit(0)
        inside = (F.col("doc_id") == doc_id) & (F.col("bucket") >= begins) & (F.col("bucket") <= last // self.lines)
        return self.findings().filter(inside).filter((F.col("line") <= last) & (F.col("end_line") >= first)).drop("bucket")

    def overlapping_all(self, views: DataFrame) -> DataFrame:
        """The same for many views (doc_id, first, last), which the rows carry: a join by document and bucket, not by a range."""
        starts = views.join(self.reach(), "doc_id").filter(F.col("reach") >= F.col("first")).groupBy("doc_id", "first", "last").agg(F.min("bucket").alias("begins"))
        ends = F.floor(F.col("last") / self.lines).cast("long")
        asked = starts.filter(F.col("begins") <= ends).select("doc_id", "first", "last", F.explode(F.sequence("begins", ends)).alias("bucket"))
        return self.findings().join(asked, ["doc_id", "bucket"]).filter((F.col("line") <= F.col("last")) & (F.col("end_line") >= F.col("first"))).drop("bucket")

    def summary(self) -> DataFrame:
        """(doc_id, findings, rules map<string, long>) of each document with findings."""
        n = rule_counts(self.findings())
        return n.groupBy("doc_id").agg(F.sum("count").alias("findings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "count")))).alias("rules"))

    def view(self, views: DataFrame, rules: Iterable[str] | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame]:
        """(rows, counts): up to `most` findings of each view, of the named rules, with how many there are (total) and whether
        some are left out (truncated); and the findings of each view by rule before rules are chosen."""
        every = self.overlapping_all(views)
        kept = every if rules is None else every.filter(T.one_of(F.col("rule"), rules))
        each = Window.partitionBy("doc_id", "first", "last")
        placed = kept.withColumn("nth", F.row_number().over(each.orderBy(*PLACE, "rule", "message"))).withColumn("total", F.count("*").over(each))
        rows = placed.filter(F.col("nth") <= most).withColumn("truncated", F.col("total") > most)
        return rows, rule_counts(every, "doc_id", "first", "last")
