"""Text files as documents: formats by extension, an overriding format, word lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Extensions of the marked-up formats; all others are plain text.
MARKDOWN, FOUNTAIN = ("md", "markdown", "mdown", "mkd", "mdx"), ("fountain", "spmd")
#: Folders that are one document of a writing program; their inner files are no texts of their own.
PACKAGES = r"\.(?:scriv|ulysses|pages|tbx)/"


def format_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*FOUNTAIN), "fountain").otherwise("plain")


def read_texts(spark: SparkSession, patterns: Iterable[str], kind: str | None = None) -> DataFrame:
    """(doc_id, name, format, source) of whole text files, each file once however many patterns fit it.

    A pattern without a file fails, as Spark's reader does. doc_id is a hash of the path: the same file has the same id in
    every run and no count of all files is needed.
    """
    files = spark.read.text(list(dict.fromkeys(patterns)), wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("source"))
    files = files.filter(~F.col("name").rlike(PACKAGES)).dropDuplicates(["name"])
    return files.select(F.xxhash64("name").alias("doc_id"), "name", (F.lit(kind) if kind else format_of(F.col("name"))).alias("format"), "source")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(entry) of a word list: one entry a line, folded; blank lines and those that begin with # are no entries."""
    entry = F.trim("value")
    return spark.read.text(path).filter((entry != "") & ~entry.startswith("#")).select(T.fold(entry).alias("entry")).distinct()
