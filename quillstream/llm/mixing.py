"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mean above CHUNK_MEAN is drawn as a sum of equal parts, so that exp(-mean) never underflows; TERMS covers each part.
CHUNK_MEAN, TERMS, BROADCAST_SOURCES = 8.0, 64, 10_000


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of an MD5 over the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def target_means(docs: DataFrame, weights: DataFrame | None = None, repetition: float = 1.0, power: float = 0.5) -> DataFrame:
    """(source, n_docs, mean, parts, cdf): how often a document of each source is repeated on average.

    Without `weights` (source, weight) a source weighs n_docs ** power. A source that `weights` lacks, or with a weight that
    isn't positive, gets mean 0. A null source is a source of its own. On average repetition * n documents come out.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(power)))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum("weight").alias("weight"))
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("given")), "left").withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).drop("given")
    total = counts.agg(F.sum("n_docs").alias("n"), F.sum("weight").alias("w")).first()
    n, w = float(total["n"] or 0), float(total["w"] or 0) or 1.0
    out = counts.withColumn("mean", F.lit(repetition * n / w) * F.col("weight") / F.col("n_docs"))
    out = out.withColumn("parts", F.greatest(F.ceil(F.col("mean") / CHUNK_MEAN).cast("int"), F.lit(1)))
    m = "(mean / parts)"
    step = f"(a, k) -> named_struct('p', a.p * {m} / k, 'cdf', array_append(a.cdf, element_at(a.cdf, -1) + a.p * {m} / k))"
    start = f"named_struct('p', exp(-{m}), 'cdf', array(exp(-{m})))"
    return out.withColumn("cdf", F.expr(f"aggregate(sequence(1, {TERMS}), {start}, {step}, a -> a.cdf)"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, seed: int = 7, repetition: float = 1.0, power: float = 0.5, copy: str = "copy", key: str = "mix_key") -> DataFrame:
    """Each document as often as a hash-seeded Poisson draw says, with `copy` (from 1) and `mix_key`, dealt at random.

    The draw inverts the distribution at a uniform number hashed from seed and doc_id: rerun tasks repeat it, and repeated
    rows are repeated alike. Rows go to partitions by the hash of `mix_key` and are sorted by it there, so partitions read
    in turn are one global shuffle. Null ids hash as 'null', null sources are a source, an empty table stays empty. The two
    columns are named by `copy` and `key`; columns of the caller with these names are an error, as they would be lost. Names
    that the operator uses inside (__*) are replaced.
    """
    spark = docs.sparkSession
    if taken := {copy, key} & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are taken; name others")
    means = target_means(docs, weights, repetition, power).select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    if means.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:  # else Catalyst joins by shuffling, and splits hot sources
        means = F.broadcast(means)
    out = docs.join(means, docs["source"].eqNullSafe(means["__source"]))
    u = lambda k: uniform(F.lit(seed), F.col("doc_id"), k)
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), u)  # hashed once a part, not once a term
    drawn = F.aggregate(draws, F.lit(0), lambda a, x: a + F.size(F.filter("__cdf", lambda c: c <= x)))
    out = out.withColumn("__n", drawn).filter("__n > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    mixed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"mix{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("__nth"))), 1, 13), 16, 10).cast("long")
    out = out.withColumn(key, mixed).withColumn(copy, F.col("__nth")).drop("__source", "__parts", "__cdf", "__n", "__nth")
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, "doc_id", copy)
