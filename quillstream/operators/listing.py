"""Results as lines of text for readers: aligned tables, ranked lists with what they leave out, findings with their excerpts.

Lines are rows in order (n, line). A listing is of bounded length, stated by its parameter; what it leaves out is counted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def minutes(value: Column) -> Column:
    """Minutes as `7 min`, from an hour on as `2h 05m`."""
    total = F.round(value).cast("long")
    return F.when(total < 60, F.concat(total.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(total / 60).cast("string"), F.lit("h "), F.lpad((total % 60).cast("string"), 2, "0"), F.lit("m")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def signed(n: Column) -> Column:
    """A whole number with its sign; 0 is +0."""
    return F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("long").cast("string"))


def trimmed(value: Column) -> Column:
    """A number without decimals if it is whole, else with two."""
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))


def _numbered(df: DataFrame, order: Iterable[str | Column], most: int) -> DataFrame:
    """The first `most` rows with their number from 1; each task keeps its own first ones before they meet."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))  # of at most `most` rows


def aligned(df: DataFrame, order: Iterable[str | Column], right: Iterable[str] = (), most: int = 200) -> DataFrame:
    """(n, line): a header, a rule and up to `most` rows in order, columns as wide as their longest cell, two spaces apart.

    Columns of `right` are set right, others left, the last of these without trailing spaces. Nulls are empty cells.
    """
    columns, right = df.columns, set(right)
    cells = _numbered(df, order, most).select("n", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    found = cells.agg(*[F.max(F.length(c)).alias(c) for c in columns]).first()  # one row
    widths = [max(len(c), found[c] or 0) for c in columns]

    def line(parts: list[Column]) -> Column:
        out = []
        for k, (name, cell, width) in enumerate(zip(columns, parts, widths, strict=True)):
            out.append(F.lpad(cell, width, " ") if name in right else cell if k == len(columns) - 1 else F.rpad(cell, width, " "))
        return F.concat_ws("  ", *out)

    head = [line([F.lit(c) for c in columns]), line([F.lit("─" * w) for w in widths])]
    spark = df.sparkSession
    top = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k - 1).cast("long").alias("n"), x.alias("line")) for k, x in enumerate(head)])).alias("x")).select("x.*")
    return top.unionByName(cells.select("n", line([F.col(c) for c in columns]).alias("line")))


def ranked(counts: DataFrame, item: str, label: str, limit: int, total_words: int | None = None) -> DataFrame:
    """(n, line): items (item, count) by count, then by name, with their rate a thousand words; and how many more there are."""
    columns = [F.col(item).alias(label), F.col("count")]
    if total_words is not None:
        columns.append(F.format_string("%.1f", T.per_thousand(F.col("count"), F.lit(total_words)) + 1e-9).alias("per 1k"))
    shown = counts.select(*columns)
    n = counts.count()
    if not n:
        return counts.sparkSession.createDataFrame([(0, "Nothing found.")], "n long, line string")
    out = aligned(shown, (F.desc("count"), label), ("count", "per 1k"), limit)
    if n > limit:
        out = out.unionByName(counts.sparkSession.createDataFrame([(limit + 1, f"… {n - limit} more")], "n long, line string"))
    return out


def listed(found: DataFrame, most: int = 200) -> DataFrame:
    """(n, line) of located findings in order of document and place: place, rule and message, and the excerpt if it says more."""
    rows = _numbered(found, ("doc_id", "line", "column", "rule", "message"), most)
    place = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string"), F.col("column").cast("string"))
    first = F.concat_ws("  ", place, "rule", "message")
    lines = F.when(F.col("text") == F.col("message"), F.array(first)).otherwise(F.array(first, F.concat(F.lit("    "), F.col("text"))))
    return rows.select("n", F.posexplode(lines).alias("k", "line")).select((F.col("n") * 2 + F.col("k")).cast("long").alias("n"), "line")
