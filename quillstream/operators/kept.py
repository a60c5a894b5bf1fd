"""Metrics kept by content: a table keyed by a hash of text and settings, so that only texts never seen before are cut and measured.

The table is a folder of Parquet, each run's new rows appended as a folder of their own. A row holds what a measure says of one
text; documents with equal texts share it, and a document that moves or changes back finds it again. Changed settings change
every key. Rows whose text no document has any more are left out of results; once they are more than the rest, the current ones are
written anew and the others go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

Measure = Callable[[DataFrame], DataFrame]


def settings_key(settings: Mapping[str, object]) -> str:
    """A hash of settings: lists count as sets of entries, order of names doesn't matter."""
    plain = lambda x: sorted(map(repr, x.items() if isinstance(x, Mapping) else x)) if isinstance(x, (Mapping, list, tuple, set, frozenset)) else x
    return hashlib.sha256(repr([(k, plain(v)) for k, v in sorted(settings.items())]).encode()).hexdigest()


def with_key(docs: DataFrame, settings: Mapping[str, object]) -> DataFrame:
    """docs (doc_id, text) with their `key`; a null text is another than an empty one."""
    return docs.withColumn("key", F.sha2(F.concat(F.lit(settings_key(settings)), F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit(""))), 256))


class Store:
    """A folder of measured rows. `measured` counts the texts that the last refresh had to measure."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.measured = spark, folder.rstrip("/"), 0

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def parts(self) -> list[str]:
        """Folders of runs that ended: a run that broke off leaves one without _SUCCESS, which is not read."""
        files, path = self._files()
        if not files.exists(path):
            return []
        found = [str(s.getPath()) for s in files.listStatus(path) if s.isDirectory()]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p for p in found if files.exists(done(p, "_SUCCESS")))

    def rows(self) -> DataFrame | None:
        """(key, metrics...) of everything kept; a key that two runs measured at once counts once."""
        parts = self.parts()
        return self.spark.read.parquet(*parts).dropDuplicates(["key"]) if parts else None

    def _append(self, rows: DataFrame) -> str:
        path = f"{self.folder}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def refresh(self, docs: DataFrame, measure: Measure, settings: Mapping[str, object]) -> DataFrame:
        """(doc_id, metrics...) of docs (doc_id, text); only texts whose key is new go through `measure`.

        measure takes texts (doc_id, text) and returns a row a doc_id. It is given the key as doc_id, one row a distinct text.
        A text that it gives no row for gives none here either, and is measured again by the next run. Rows that share a doc_id
        each get their row.
        """
        keyed = with_key(docs, settings)
        keys = cut(keyed.select("doc_id", "key"))
        known = self.rows()
        new = keys.select("key").distinct()
        if known is not None:
            new = new.join(known.select("key"), "key", "left_anti")
        new = cut(new)
        self.measured = new.count()
        if self.measured:
            texts = keyed.select("key", "text").join(new, "key", "left_semi").dropDuplicates(["key"])
            self._append(measure(texts.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key"))
        rows = self.rows()
        if rows is None:
            return measure(docs.select("doc_id", "text").limit(0))
        self._tidy(rows, keys)
        return keys.join(self.rows(), "key").drop("key")

    def _tidy(self, rows: DataFrame, keys: DataFrame) -> None:
        """Writes the rows in use anew and drops all others, once those are the greater part."""
        used = rows.join(keys.select("key").distinct(), "key", "left_semi")
        before, now = rows.count(), used.count()
        if before > 2 * now:
            old, kept = self.parts(), self._append(used)
            files, _ = self._files()
            for part in old:
                if part != kept:
                    files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(part), True)


def kept_metrics(docs: DataFrame, folder: str, measure: Measure, settings: Mapping[str, object]) -> DataFrame:
    """Metrics of docs (doc_id, text), measured where the folder doesn't hold them yet."""
    return Store(docs.sparkSession, folder).refresh(docs, measure, settings)
