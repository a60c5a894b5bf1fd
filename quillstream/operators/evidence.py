"""Evidence for and citations from a language model: numbered text out, quotes pinned to the source, verdicts joined back.

No client is part of the library: `ask` is any function from a prompt to the model's reply.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Bytes one request may hold, findings one request may carry, and the verdicts.
MAX_PROMPT_BYTES, MAX_FINDINGS, VERDICTS = 3_000_000, 40, ("fix", "consider", "keep")


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, line, numbered) of texts (doc_id, text): each line with its document and number before it."""
    one = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t"))
    return one.select("doc_id", (F.col("k") + 1).cast("long").alias("line"), F.concat(F.col("doc_id"), F.lit(":"), F.col("k") + 1, F.lit("| "), F.col("t")).alias("numbered"))


def fits(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes, fits): whether a document's numbered text is within one request."""
    return numbered(docs).groupBy("doc_id").agg(F.sum(F.octet_length("numbered") + 1).alias("bytes")).withColumn("fits", F.col("bytes") <= MAX_PROMPT_BYTES)


def pins(docs: DataFrame, cited: DataFrame) -> DataFrame:
    """cited with the columns at_line, column and verified: a row each citation (doc_id, line, quote, ...), however many share one.

    Of the places where the trimmed quote stands, the nearest to the cited line counts, then the first. A quote that isn't
    there, or is empty, keeps its cited line, column 0 and isn't verified; so does one of a document that there isn't. A null line counts as 1.
    """
    hint, trimmed = F.coalesce(F.col("line").cast("long"), F.lit(1)), F.regexp_replace(F.coalesce("quote", F.lit("")), r"^\s+|\s+$", "")
    asked = cited.select(F.col("doc_id"), hint.alias("hint"), trimmed.alias("quote"))
    parts = F.when(F.col("quote") != "", F.split(F.replace("text", F.col("quote"), F.lit(T.SPLIT)), T.SPLIT))
    one = asked.distinct().join(docs.select("doc_id", "text"), "doc_id").withColumn("parts", parts)
    found = one.filter(F.size("parts") > 1).select("doc_id", "hint", "quote", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    w = Window.partitionBy("doc_id", "hint", "quote").orderBy("k")
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    tail = F.length(F.substring_index("part", "\n", -1))
    inner = F.length(F.substring_index("quote", "\n", -1))
    start = F.sum(F.length("part")).over(w) + F.col("k") * F.length("quote")
    line = 1 + F.sum(ends("part")).over(w) + F.col("k") * ends("quote")
    opened = F.when(F.col("part").contains("\n"), start - tail).when((F.col("k") > 0) & F.col("quote").contains("\n"), start - F.length("part") - inner)
    placed = found.select("doc_id", "hint", "quote", "n", "k", start.alias("start"), line.alias("at"), opened.alias("opened"))
    placed = placed.withColumn("opened", F.coalesce(F.max("opened").over(w), F.lit(0))).filter("k < n - 1")
    best = placed.groupBy("doc_id", "hint", "quote").agg(F.min(F.struct(F.abs(F.col("at") - F.col("hint")).alias("d"), "start", "at", (F.col("start") - F.col("opened") + 1).alias("column"))).alias("b"))
    best = best.select(F.col("doc_id").alias("__doc"), F.col("hint").alias("__hint"), F.col("quote").alias("__quote"), "b")
    known = cited.join(best, (cited["doc_id"] == best["__doc"]) & (hint == best["__hint"]) & (trimmed == best["__quote"]), "left")
    return known.select(*cited.columns, F.coalesce("b.at", hint).cast("long").alias("at_line"), F.coalesce("b.column", F.lit(0)).cast("long").alias("column"), F.col("b.at").isNotNull().alias("verified"))


def pin(docs: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc_id, line, column, verified) of citations (doc_id, line, quote), as pins() finds them."""
    found = pins(docs, cited.select("doc_id", "line", "quote"))
    return found.select("doc_id", F.col("at_line").alias("line"), "column", "verified")


def explain(findings: DataFrame, ask: Callable[[str], str], most: int = MAX_FINDINGS) -> DataFrame:
    """Verdicts on the first `most` located findings (one request, so that many rows at most reach the driver).

    The reply is JSON: [{"index", "verdict", "note"}, ...]. Unknown indices and verdicts are ignored.
    """
    order = ("doc_id", "line", "column", "rule", "message")
    rows = findings.orderBy(*order).limit(min(most, MAX_FINDINGS)).collect()
    prompt = "\n".join(f"{k}: {r.rule}: {r.message}: {r.text}" for k, r in enumerate(rows))
    said = {x.get("index"): x for x in json.loads(ask(prompt)) if x.get("verdict") in VERDICTS} if rows else {}
    kept = [(*[r[c] for c in order], x["verdict"], x.get("note", "")) for k, r in enumerate(rows) if (x := said.get(k))]
    return findings.sparkSession.createDataFrame(kept, "doc_id long, line long, column long, rule string, message string, verdict string, note string")
