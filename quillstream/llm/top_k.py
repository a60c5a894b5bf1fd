"""Exact top-k search by inner product: histograms of scores over all executors locate each query's kth score.

Every query is scored against every vector, in blocks. Nothing sorts the scores: a pass counts them in bins, the bin that holds
a query's kth greatest score is cut into finer bins in the next pass, and once a bin is one score wide all greater scores and
enough of the equal ones are taken, those of the smallest ids first. A task sends, for each query, its highest bins alone, down
to the one in which its own count reaches k: a lower bin can't hold the kth score of all.

Vectors are arrays of numbers, turned into integers by floor(scale * x); scores are exact inner products of integers. A vector
that is null or holds a null or a component that is not finite takes no part, as query or candidate. A query meets vectors of
its own length alone. A query's own row is no candidate; other rows of its id are. Query rows equal in id and vector are
answered once. Ties go to the smaller id, a null id last. A score that a long can't hold is an error. Extra columns are ignored
and an empty table gives no row.

Queries are dealt by hash into groups of at most about GROUP rows and GROUP_BYTES bytes; one group at a time is sent to the
tasks, so what is broadcast is bounded, however many queries there are. No pass shuffles vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

GROUP, GROUP_BYTES = 16_384, 32 << 20
#: Bins of a pass, a power of two.
BITS = 8
#: Queries and vectors of a block of scores.
ROWS = 2_048


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null for a vector that takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


class Group:
    """A group of queries: ids, and by vector length the numbers of the queries and their matrix."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], kind: str) -> None:
        self.ids, self.by_length, self.at = ids, {}, {}
        for k, v in enumerate(vectors):
            self.by_length.setdefault(len(v), []).append(k)
            self.at.setdefault((int(ids[k]), v.tobytes()), k)
        self.by_length = {n: (np.array(own), np.array([vectors[k] for k in own], kind).reshape(len(own), n)) for n, own in self.by_length.items()}


def _blocks(batch: pa.RecordBatch, group: Group, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of queries, places in the batch, scores) of all pairs of equal length."""
    lists = batch.column("vector")
    lengths = np.asarray(lists.value_lengths())
    values, starts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
    for n in np.unique(lengths):
        if int(n) not in group.by_length:
            continue
        queries, matrix = group.by_length[int(n)]
        own = np.flatnonzero(lengths == n)
        for a in range(0, len(own), ROWS):
            part = own[a : a + ROWS]
            rows = values[starts[part][:, None] + np.arange(n)].astype(kind)
            for b in range(0, len(queries), ROWS):
                yield queries[b : b + ROWS], part, matrix[b : b + ROWS] @ rows.T


def _histogram(group: Group, kind: str, lows: np.ndarray, shift: int, wide: int | None, k: int):
    """For mapInArrow: (query, bin, n) of a partition's scores from lows on, in bins of 2 ** shift; `wide` ends the bins.

    Scores under a query's low are left out, and with `wide` those from low + wide on: they are counted already.
    """
    bins = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(group.ids), bins), np.int64)
        for batch in batches:
            for queries, _, scores in _blocks(batch, group, kind):
                m = len(queries)
                if wide is None:  # all scores fall into the bins
                    at = ((scores.astype(np.float64) - float(lows[0])) * 2.0**-shift).astype(np.int32) if kind != "object" else ((scores - int(lows[0])) >> shift).astype(np.int32)
                    at += (np.arange(m, dtype=np.int32) * bins)[:, None]
                    counts[queries] += np.bincount(at.ravel(), minlength=m * bins).reshape(m, bins)
                else:
                    low = lows[queries].astype(scores.dtype)[:, None]
                    q, j = np.nonzero((scores >= low) & (scores < low + wide))
                    inside = scores[q, j] - low[q, 0]
                    at = ((inside >> shift).astype(np.int64) if kind == "object" else inside.astype(np.int64) >> shift) + q * bins
                    counts[queries] += np.bincount(at, minlength=m * bins).reshape(m, bins)
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts  # of the bins over each
        q, b = np.nonzero((counts > 0) & (above <= k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["q", "bin", "n"])

    return run


def _candidates(group: Group, kind: str, least: np.ndarray, ties: np.ndarray):
    """For mapInArrow: (q, vec_id, score, own) of scores over `least`, and of those equal to it the `ties` of the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bool, int, bool]]] = {}
        for batch in batches:
            ids, vectors = batch.column("vec_id"), batch.column("vector")
            null, number = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            out: list[tuple] = []
            for queries, part, scores in _blocks(batch, group, kind):
                q, j = np.nonzero(scores >= least[queries].astype(scores.dtype)[:, None])
                for a, b, score in zip(queries[q].tolist(), part[j].tolist(), scores[q, j].tolist(), strict=True):
                    vec_id = None if null[b] else int(number[b])
                    own = vec_id == int(group.ids[a]) and group.at.get((vec_id, np.array(vectors[b].values.to_numpy(), np.int64).tobytes())) == a
                    if score > least[a]:
                        out.append((a, vec_id, int(score), own))
                    else:
                        held.setdefault(a, []).append((vec_id is None, vec_id or 0, own))
            for a, equal in held.items():
                if len(equal) > 2 * ties[a]:
                    held[a] = sorted(equal)[: ties[a]]
            yield _batch(out)
        yield _batch([(a, None if empty else vec_id, int(least[a]), own) for a, equal in held.items() for empty, vec_id, own in sorted(equal)[: ties[a]]])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["q", "vec_id", "score", "own"])


def _kth(counts: DataFrame, n: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the bin in which the count from above reaches what is needed (-1: none), and what is counted over it."""
    over = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    summed = counts.groupBy("q", "bin").agg(F.sum("n").alias("n")).select("q", "bin", (over - F.col("n")).alias("above"), over.alias("reached"))
    want = F.broadcast(counts.sparkSession.createDataFrame(list(enumerate(needed.tolist())), "q int, needed long"))  # a row for each query of the group
    found = summed.join(want, "q").filter((F.col("above") < F.col("needed")) & (F.col("reached") >= F.col("needed"))).select("q", "bin", "above").toArrow()
    bins, above = np.full(n, -1), np.zeros(n, np.int64)
    q = found.column("q").to_numpy()
    bins[q], above[q] = found.column("bin").to_numpy(), found.column("above").to_numpy()
    return bins, above


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row that is a query, over all rows but its own.

    Fewer than k where a query has fewer candidates; a query without any gives no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), integers(F.col(vector_column), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vector").isNotNull())
    rows = materialise(rows, "vectors")
    queries = materialise(rows.filter(F.col("asks") & F.col("vec_id").isNotNull()).select("vec_id", "vector").distinct(), "queries")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    highest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    n, norm_q = queries.agg(F.count("*"), F.max(square)).first()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return out
    norm, most, length = rows.agg(F.max(square), F.max(highest), F.max(F.size("vector"))).first()
    bound = (norm * norm_q) ** 0.5 * 1.000001 + 2  # of all scores, by Cauchy and Schwarz
    terms = most * most * max(length, 1)  # of every sum of products
    kind = "float32" if terms < 2**24 else "float64" if terms < 2**52 else "object"
    groups = max(-(-n // (GROUP * 7 // 8)), -(-n * length * 8 // GROUP_BYTES), 1)
    found = []
    for g in range(groups):
        own = queries if groups == 1 else queries.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(groups)) == g)
        table = own.toArrow()  # a group of bounded size
        if table.num_rows:
            found.append(_top_k_of(rows, table, k, bound, kind))
    for part in found:
        out = out.unionByName(part)
    return out


def _top_k_of(rows: DataFrame, table: pa.Table, k: int, bound: float, kind: str) -> DataFrame:
    spark = rows.sparkSession
    vectors = [np.array(v, np.int64) for v in table.column("vector").to_pylist()]
    group = Group(table.column("vec_id").to_numpy(), vectors, kind)
    n, sent = len(vectors), rows.select("vec_id", "vector")
    shift = max(int(2 * bound).bit_length() - BITS, 0)
    lows, needed, wide = [-int(bound)] * n, np.full(n, k), None
    own_score = [sum(x * x for x in v.tolist()) for v in vectors]
    short = np.zeros(n, bool)
    while True:
        low = np.array(lows, "int64" if kind != "object" else "object")
        counts = sent.mapInArrow(_histogram(group, kind, low, shift, wide, k), "q int, bin int, n long")
        # a query's own row has been counted as well
        less = [(q, (s - a) >> shift, -1) for q, (s, a) in enumerate(zip(own_score, lows, strict=True)) if a <= s and (wide is None or s < a + wide)]
        counts = counts.unionByName(spark.createDataFrame(less, "q int, bin int, n long"))
        bins, above = _kth(counts, n, needed)
        if wide is None:
            short = bins < 0  # fewer candidates than k: all are taken
        lows = [a + (int(b) << shift) if b >= 0 else a for a, b in zip(lows, bins, strict=True)]
        needed = np.where(short, needed, needed - above)
        if not shift:
            break
        wide, shift = 1 << shift, max(shift - BITS, 0)
    ties = np.where(short, 0, needed) + 1  # one more, as its own row may be among them
    candidates = sent.mapInArrow(_candidates(group, kind, np.array(lows, "int64" if kind != "object" else "object"), ties), "q int, vec_id long, score long, own boolean")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("own")]
    each = Window.partitionBy("q")
    placed = candidates.withColumn("place", F.row_number().over(each.orderBy(*order))).withColumn("self", F.min(F.when(F.col("own"), F.col("place"))).over(each))
    ranked = placed.filter(F.col("self").isNull() | (F.col("place") != F.col("self"))).withColumn("rank", F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0)).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(group.ids.tolist())), "q int, query_id long")
    return ranked.join(F.broadcast(ids), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")  # a row for each query of the group
