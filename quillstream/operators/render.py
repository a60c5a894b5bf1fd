"""Results for readers: a JSON text a row, a page of HTML a document. Pages are rows, written by as many tasks as there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def polyline(values: Column, width: int = 600, height: int = 80) -> Column:
    """An SVG line of an array of numbers; equal numbers give a level line."""
    low, high, n = F.array_min(values), F.array_max(values), F.size(values)
    x = lambda i: F.round(i * float(width) / F.greatest(n - 1, F.lit(1)), 1)
    y = lambda v: F.round(F.when(high > low, (high - v) / (high - low)).otherwise(0.5) * height, 1)
    points = F.array_join(F.transform(values, lambda v, i: F.concat_ws(",", x(i).cast("string"), y(v).cast("string"))), " ")
    return F.concat(F.lit(f'<svg viewBox="0 0 {width} {height}"><polyline fill="none" stroke="currentColor" points="'), points, F.lit('"/></svg>'))


#: What a page shows first: a metric and its name, by the metric's column.
STATS = {
    "words": "words", "sentences": "sentences", "paragraphs": "paragraphs", "reading_minutes": "minutes to read", "flesch_reading_ease": "reading ease",
    "flesch_kincaid_grade": "grade level", "mattr": "MATTR", "dialogue_ratio": "dialogue",
}
CHIPS = {"word": "Frequent words", "repeat": "Repeated phrases", "opener": "Sentence openers"}
TREND = {"words": "Words", "echoes_per_1k": "Echoes", "adverbs_per_1k": "Adverbs", "cliches_per_1k": "Cliches"}


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"<section><h2>{title}</h2>"), body, F.lit("</section>"))


def _listed(order: str, item: Column, of: Column | None = None) -> Column:
    """The items of a group in order, joined; of those rows alone that are meant, null if there are none."""
    row = F.struct(F.col(order), item.alias("item"))
    each = F.collect_list(row if of is None else F.when(of, row))
    return F.when(F.size(each) > 0, F.array_join(F.transform(F.array_sort(each), lambda x: x["item"]), ""))


def pages(metrics: DataFrame, review: DataFrame | None = None, tops: DataFrame | None = None, trend: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, html): a standalone page a document, of a row of metrics each.

    review: ranked findings (doc_id, nth, of, rule, message, line, column, text); a page says how many it leaves out. tops:
    (doc_id, kind, rank, item, count), shown as chips. trend: (doc_id, rev, words and rates), lines of at least two revisions.
    A document without rows in one of them has no such section but `None`. Everything is escaped.
    """
    has = [c for c in STATS if c in metrics.columns]
    stat = lambda c: F.concat(F.lit('<div class="stat"><span class="value">'), escaped(F.col(c)), F.lit(f'</span><span class="label">{STATS[c]}</span></div>'))
    rates = [c for c in metrics.columns if c.endswith("_per_1k")]
    flag = lambda c: F.concat(F.lit(f"<tr><td>{c.removesuffix('_per_1k').replace('_', ' ')}</td><td>"), escaped(F.col(c)), F.lit("</td></tr>"))
    parts = [_section("Overview", F.concat(F.lit('<div class="stats">'), *[stat(c) for c in has], F.lit("</div>")))]
    if rates:
        parts.append(_section("Flags per 1,000 words", F.concat(F.lit("<table>"), *[flag(c) for c in rates], F.lit("</table>"))))
    out = metrics
    none = F.lit('<p class="muted">None</p>')
    if review is not None:
        place = F.concat_ws(":", escaped(F.col(key)), F.col("line").cast("string"), F.col("column").cast("string"))
        item = F.concat(F.lit('<li><span class="location">'), place, F.lit('</span><span class="rule">'), escaped(F.col("rule")), F.lit("</span><p>"), escaped(F.col("message")), F.lit("</p><blockquote>"), escaped(F.col("text")), F.lit("</blockquote></li>"))
        out = out.join(review.groupBy(key).agg(_listed("nth", item).alias("__review"), F.count("*").alias("__shown"), F.max("of").alias("__of")), key, "left")
        said = F.concat(F.lit("<p>"), F.col("__shown").cast("string"), F.lit(" of "), F.col("__of").cast("string"), F.lit(" findings.</p>"))
        parts.append(_section("Review next", F.coalesce(F.concat(said, F.lit("<ol>"), F.col("__review"), F.lit("</ol>")), none)))
    if tops is not None:
        chip = F.concat(F.lit("<li>"), escaped(F.col("item")), F.lit(" <b>"), F.col("count").cast("string"), F.lit("</b></li>"))
        out = out.join(tops.groupBy(key).agg(*[_listed("rank", chip, F.col("kind") == kind).alias(f"__{kind}") for kind in CHIPS]), key, "left")
        parts += [_section(title, F.coalesce(F.concat(F.lit('<ul class="chips">'), F.col(f"__{kind}"), F.lit("</ul>")), none)) for kind, title in CHIPS.items()]
    if trend is not None:
        drawn = [c for c in TREND if c in trend.columns]
        rows = trend.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rev", *[F.col(c).cast("double").alias(c) for c in drawn]))).alias("t")).filter(F.size("t") > 1)
        line = lambda c: F.concat(F.lit(f'<p class="muted">{TREND[c]}</p>'), polyline(F.transform("t", lambda x: x[c])))
        lines = F.concat(*map(line, drawn))
        out = out.join(rows.select(key, lines.alias("__trend")), key, "left")
        parts.append(F.coalesce(_section("Trend", F.col("__trend")), F.lit("")))
    page = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>Report</title></head><body><h1>Report</h1>'), *parts, F.lit("</body></html>"))
    return out.select(key, page.alias("html"))
