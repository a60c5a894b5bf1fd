"""URL filters: explicit rules first, then a path-template tree for each host with smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: SUPPORT: urls that a branch needs; Z: deviations beyond which two rates differ; SMOOTHS: least and most weight of a host's rate.
SUPPORT, Z, SMOOTHS, PURITY, BROADCAST_BYTES = 20, 2.58, (1.0, 1000.0), 0.5, 32 << 20
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcasting if its rows take at most BROADCAST_BYTES; else Catalyst shuffles."""
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def literal(segment: Column) -> Column:
    """A segment as part of a template: one that looks like a wildcard or a merged branch gets a backslash."""
    return F.when(segment.rlike(r"^[*{\\]"), F.concat(F.lit("\\"), segment)).otherwise(segment)


def differ(b1: Column, m1: Column, b2: Column, m2: Column) -> Column:
    """Whether two shares b / m differ by over Z deviations of their pooled rate (half a case added to either side)."""
    rate = (b1 + b2 + 0.5) / (m1 + m2 + 1)
    return F.abs(b1 / m1 - b2 / m2) > Z * F.sqrt(rate * (1 - rate) * (1 / m1 + 1 / m2))


def templates(urls: DataFrame) -> list[DataFrame | None]:
    """For each depth, the branches (at, branch, name) that stay apart, or None; every other segment there is a wildcard.

    A segment keeps a branch of its own if it has support (at least SUPPORT urls) and its labelled bad rate differs from that
    of all its siblings together by a two-proportion test; else it is generalised into the wildcard. Of the branches kept
    below one parent, in order of their rates, neighbours that don't differ by the same test are merged into one, so that
    their children grow as one subtree. Depths end where fewer than SUPPORT urls have a segment, so that no branch there
    could have support.
    """
    lengths = urls.groupBy(F.size("segments").alias("length")).count().collect()  # one row a path length
    kept: list[DataFrame | None] = []
    while sum(r["count"] for r in lengths if r["length"] > len(kept)) >= SUPPORT:
        at = apply_templates(urls, kept).withColumn("segment", F.get("segments", F.lit(len(kept)))).filter("segment is not null")
        child = at.groupBy("template", "segment").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), F.count("bad").alias("m"))
        child = materialise(child, "branches")
        parent = child.groupBy("template").agg(F.sum("b").alias("all_b"), F.sum("m").alias("all_m")).select(F.col("template").alias("of"), "all_b", "all_m")
        both = child.filter((F.col("n") >= SUPPORT) & (F.col("m") > 0)).join(parent, F.col("template") == F.col("of")).filter("all_m > m")
        apart = both.filter(differ(F.col("b"), F.col("m"), F.col("all_b") - F.col("b"), F.col("all_m") - F.col("m")))
        order = Window.partitionBy("template").orderBy(F.col("b") / F.col("m"), "segment")
        new = F.lag("m").over(order).isNull() | differ(F.col("b"), F.col("m"), F.lag("b").over(order), F.lag("m").over(order))
        run = apart.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
        merged = Window.partitionBy("template", "run")
        name = F.when(F.count("*").over(merged) == 1, literal(F.col("segment"))).otherwise(F.concat(F.lit("{"), F.min("segment").over(merged), F.lit(",+"), F.count("*").over(merged) - 1, F.lit("}")))
        stay = materialise(run.select(F.col("template").alias("at"), F.col("segment").alias("branch"), name.alias("name")), "templates")
        kept.append(None if stay.isEmpty() else stay)
    return kept


def apply_templates(urls: DataFrame, kept: list[DataFrame | None], whole: bool = False) -> DataFrame:
    """urls with `template`: the host and its segments, wildcards where no branch was kept; if whole, deeper ones are one `**`."""
    out = urls.withColumn("template", F.col("host"))
    for depth, branches in enumerate(kept):
        segment = F.get("segments", F.lit(depth))
        if branches is None:
            branch = F.lit("*")
        else:
            out = out.join(small(branches), (F.col("template") == F.col("at")) & (segment == F.col("branch")), "left")
            branch = F.coalesce("name", F.lit("*"))
        step = F.when(segment.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), branch))
        out = out.withColumn("template", F.concat("template", step)).drop("at", "branch", "name")
    if whole:
        out = out.withColumn("template", F.when(F.size("segments") > len(kept), F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    return out


def purities(done: DataFrame) -> DataFrame:
    """(of, purity) of each template of done (host, template, bad).

    The purity of a template is its share of bad labels, smoothed towards its host's share, and that towards all pages'. How
    many labels the host's share counts for is learnt: as many as make the spread of templates around their hosts, beyond
    what chance gives, that of a beta distribution (method of moments), within SMOOTHS.
    """
    all_bad = done.agg(F.coalesce((F.sum("bad") + 1) / (F.count("bad") + 2), F.lit(0.5))).first()[0]
    by = done.groupBy("template", "host").agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("b"), F.count("bad").alias("m"))
    hosts = by.groupBy(F.col("host").alias("at")).agg(((F.sum("b") + 8.0 * F.lit(all_bad)) / (F.sum("m") + 8.0)).alias("rate"))
    both = materialise(by.join(hosts, F.col("host") == F.col("at")), "rates")
    chance = F.col("rate") * (1 - F.col("rate"))
    sums = both.filter("m > 1").agg(F.sum(F.pow(F.col("b") - F.col("m") * F.col("rate"), 2)).alias("seen"), F.sum(F.col("m") * chance).alias("one"), F.sum(F.col("m") * (F.col("m") - 1) * chance).alias("two")).first()
    rho = ((sums["seen"] or 0.0) - (sums["one"] or 0.0)) / (sums["two"] or 1.0)  # correlation of two labels of one template
    smooth = min(max(1 / rho - 1 if rho > 0 else SMOOTHS[1], SMOOTHS[0]), SMOOTHS[1])
    return both.select(F.col("template").alias("of"), ((F.col("b") + smooth * F.col("rate")) / (F.col("m") + smooth)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    labels: (page_id, bad 0/1). Where no rule fits, a template is rejected if its smoothed purity (see purities) is over
    PURITY. A null url, or one without ://, has an empty host and path and is judged as such; repeated rows are judged alike,
    a page with several labels is bad if one says so; extra columns are ignored; an empty table stays empty.
    """
    parts = pages.select(F.col("page_id"), F.col("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    marks = labels.filter("bad is not null and page_id is not null").groupBy(F.col("page_id").alias("of")).agg(F.max("bad").cast("double").alias("bad"))
    urls = parts.join(marks, F.col("page_id") == F.col("of"), "left").withColumn("segments", F.filter(F.split("path", "/"), lambda x: x != "")).select("page_id", "host", "path", "segments", "bad")
    urls = materialise(urls, "urls")
    done = materialise(apply_templates(urls, templates(urls), True).select("page_id", "host", "path", "bad", "template"), "templated")
    pure = small(materialise(purities(done), "purity"))
    out = done.join(pure, F.col("template") == F.col("of")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("ruled.verdict", F.when(F.col("purity") > PURITY, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
