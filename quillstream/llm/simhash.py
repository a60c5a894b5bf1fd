"""SimHash near-duplicates found in vantage-point trees over Hamming distance.

Fingerprints are dealt to the leaves of a few vantage-point trees. Each tree measures Hamming distance on one group of bits
only. Where the groups are disjoint and cover all 64 bits, two fingerprints within `radius` bits differ by at most
radius // groups bits in one group at least, so a tree searched with that smaller radius prunes far better than one tree
with the whole radius, and the result is still exact. A fingerprint lives in one leaf and visits every later leaf that the
triangle bounds cannot rule out. Leaves compare whole fingerprints and return spanning links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, release, with_text
from .components import connected_components

#: Leaves hold about LEAF fingerprints up to LEAF << MAX_DEPTH of them. SAMPLE: fingerprints at least that trees are built from.
SEED, LEAF, BLOCK, MAX_DEPTH, SAMPLE = 42, 1024, 8192, 17, 20_000
SKETCH = 64
#: Members and shingles of one block of a group whose texts are compared exactly; a task takes two blocks at most.
EXACT_ROWS, EXACT_SHINGLES = 2048, 4_000_000
_PROBES = np.argsort(np.random.default_rng(SEED).random((SKETCH, SKETCH)), 0)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = text.encode().lower().split()  # lower-cases A-Z alone, splits on ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8").astype(np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, counted eight at a time in the bytes of 64-bit words."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    out = 0
    for k in range(8):
        sums = ((padded >> np.uint64(k)) & np.uint64(0x0101010101010101)).reshape(-1, 255).sum(1, dtype=np.uint64)
        for byte, count in enumerate(sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64).tolist()):
            if 2 * count > n:
                out |= 1 << (8 * byte + k)
    return out


def min_sketch(hashes: np.ndarray) -> bytes:
    """SKETCH bytes of one-permutation minima: two texts share each with about the Jaccard likeness of their shingles."""
    if not len(hashes):
        return bytes(SKETCH)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    slot = (mixed >> np.uint64(58)).astype(np.int64)
    value = mixed & np.uint64((1 << 58) - 1)
    least = np.full(SKETCH, np.uint64(2**64 - 1))
    np.minimum.at(least, slot, value)
    full = least != np.uint64(2**64 - 1)
    if not full.all():  # an empty slot takes the minimum of the first full one in an order of its own, the same for all texts
        least = np.where(full, least, least[_PROBES[full[_PROBES].argmax(0), np.arange(SKETCH)]])
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(text, width)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return with_text(docs).mapInArrow(run, "doc_id long, fp long")


def text_key() -> Column:
    """A hash of column text, null as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def shingle_sets(docs: DataFrame, width: int, whole: bool = False) -> DataFrame:
    """(doc_id, key, id, size, fp, sketch) of each text's set of shingles, repeats counted once; equal sets have equal ids.

    key is the text's hash. With `whole`, (doc_id, key, id, size, sketch, grams) instead, grams being the set's sorted hashes.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, fps, sketches, grams = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = np.unique(shingle_hashes(text, width))
                raw = h.tobytes()
                ids.append(xxhash.xxh3_64_intdigest(raw))
                sizes.append(len(h))
                sketches.append(min_sketch(h))
                if whole:
                    grams.append(raw)
                else:
                    fps.append(majority_bits(h))
            out = [batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            if whole:
                yield pa.RecordBatch.from_arrays([*out, pa.array(sketches, pa.binary()), pa.array(grams, pa.binary())], ["doc_id", "key", "id", "size", "sketch", "grams"])
            else:
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())], ["doc_id", "key", "id", "size", "fp", "sketch"])

    keyed = with_text(docs).select("doc_id", text_key().alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key long, id long, size long, " + ("sketch binary, grams binary" if whole else "fp long, sketch binary"))


class Forest:
    """Vantage points and median distances of complete binary trees, one for each group of bits."""

    def __init__(self, sample: np.ndarray, groups: list[int], depth: int, reach: int) -> None:
        rng = np.random.default_rng(SEED)
        self.groups, self.depth, self.reach = np.array(groups, np.uint64), depth, reach
        self.points = np.zeros((len(groups), 1 << depth), np.uint64)
        self.medians = np.zeros((len(groups), 1 << depth), np.int64)
        for g, mask in enumerate(self.groups):
            held = {1: sample & mask}
            for node in range(1, 1 << depth):
                own = held.pop(node, sample[:0])
                # of a few candidates, the vantage point whose median splits its sample most evenly
                best = (-1, np.uint64(0), 0)
                for p in rng.choice(own, min(8, len(own)), replace=False) if len(own) else []:
                    d = np.bitwise_count(own ^ p).astype(np.int64)
                    for m in {int(np.median(d)), int(np.median(d)) - 1}:
                        best = max(best, (min((d <= m).sum(), (d > m).sum()), p, m), key=lambda x: x[0])
                self.points[g, node], self.medians[g, node] = best[1], best[2]
                near = np.bitwise_count(own ^ best[1]) <= best[2]
                held[2 * node], held[2 * node + 1] = own[near], own[~near]

    def leaves(self, g: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): the leaf in which each fingerprint lives, and the later leaves that it has to visit."""
        row, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        own = fps & self.groups[g]
        for _ in range(self.depth):
            d, m = np.bitwise_count(own[row] ^ self.points[g, node]).astype(np.int64), self.medians[g, node]
            near, far = d - self.reach <= m, d + self.reach > m
            row, home, node = np.concatenate((row[near], row[far])), np.concatenate(((home & (d <= m))[near], (home & (d > m))[far])), np.concatenate((2 * node[near], 2 * node[far] + 1))
        lives = np.zeros(len(fps), np.int64)
        lives[row[home]] = node[home]
        keep = home | (node > lives[row])
        return row[keep], node[keep] - (1 << self.depth), home[keep]


def disjoint_groups(n: int) -> list[int]:
    """64 bits dealt to n groups."""
    return [sum(1 << b for b in range(64) if b * n // 64 == g) for g in range(n)]


def random_groups(n: int, bits: int) -> list[int]:
    rng = np.random.default_rng(SEED)
    return [int(sum(1 << int(b) for b in rng.choice(64, bits, replace=False))) for _ in range(n)]


def spanning_links(fps: np.ndarray, home: np.ndarray, radius: int, cross: np.ndarray | None = None, sketches: np.ndarray | None = None, alike: int = 0) -> list[tuple[int, int]]:
    """Pairs of rows that link the components of all rows within `radius`; pairs of two visitors need no look here.

    cross: sides 0 and 1, of which only pairs across count. sketches: rows whose sketches agree in `alike` bytes link.
    """
    n = len(fps)
    label, out = np.arange(n), []
    rows = np.flatnonzero(home)
    for k in range(0, len(rows), 256):
        block = rows[k : k + 256]
        close = np.bitwise_count(fps[block, None] ^ fps[None, :]) <= radius
        close[np.arange(len(block)), block] = False
        if cross is not None:
            close &= cross[block, None] != cross[None, :]
        for r in np.flatnonzero(close.any(1)):
            i = block[r]
            near = np.flatnonzero(close[r])
            near = near[label[near] != label[i]]
            if sketches is not None and len(near):
                near = near[(sketches[near] == sketches[i]).sum(1) >= alike]
            if len(near):
                roots, first = np.unique(label[near], return_index=True)
                out += [(int(i), int(near[f])) for f in first]
                label[np.isin(label, roots)] = label[i]
    return out


def near_links(nodes: DataFrame, groups: list[int], reach: int, radius: int, alike: int = 0) -> DataFrame:
    """Links (a, b) between the ids of nodes (id, fp[, sketch]) that span the components of all links found."""
    spark = nodes.sparkSession
    wide = "sketch" in nodes.columns
    n = nodes.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / LEAF))))
    some = max(SAMPLE, 4 << depth)  # a few for each leaf, 4 << MAX_DEPTH at most
    sample = np.array([r[0] for r in nodes.select("fp").distinct().orderBy(F.xxhash64("fp")).limit(some).collect()], np.int64).view(np.uint64)
    forest = spark.sparkContext.broadcast(Forest(sample, groups, depth, reach))  # at most 2 ** MAX_DEPTH nodes a tree

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for g in range(len(trees.groups)):
                row, leaf, home = trees.leaves(g, fps)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), g, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(home), *taken.columns], ["tree", "leaf", "home", *batch.schema.names])

    dealt = nodes.select("id", "fp", *["sketch"] * wide).mapInArrow(deal, "tree int, leaf int, home boolean, id long, fp long" + ", sketch binary" * wide)
    if not wide:
        dealt = materialise(dealt, "leaves")
    # a leaf of more than BLOCK rows is compared block by block: each task takes two blocks at most
    sizes = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = dealt.join(F.broadcast(sizes), ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # len(groups) * 2 ** MAX_DEPTH rows at most
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp", "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), "home", "id", "fp", *["sketch"] * wide)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        fps, home = table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy(zero_copy_only=False)
        cross = None
        if key[2].as_py() != key[3].as_py():
            cross = table["second"].to_numpy(zero_copy_only=False)
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH) if wide else None
        found = spanning_links(fps, home, radius, cross, sketches, alike)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return dealt.groupBy("tree", "leaf", "low", "high").applyInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, trees: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): exact components of fingerprints within `radius` bits.

    Null and empty texts have fingerprint zero, linked like any other. A row whose doc_id is null links as well; a component
    without any doc_id has a null component_id. Repeated rows stay; extra columns are ignored; empty in, empty out.
    """
    fps = materialise(fingerprints(docs, width), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes").withColumn("id", F.col("fp"))
    links = near_links(nodes, disjoint_groups(trees), radius // trees, radius)
    stars = connected_components(links).select(F.col("id").alias("at"), "component")
    named = materialise(nodes.join(stars, F.col("id") == F.col("at"), "left").select("fp", "least", F.coalesce("component", "id").alias("component")), "simhash-named")
    least = named.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("component") == F.col("of")).select(F.col("fp").alias("own"), "component_id")
    out = fps.join(named, F.col("fp") == F.col("own"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike_links(grams: list[np.ndarray], sketches: np.ndarray, similarity: float, alike: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows, each of Jaccard likeness `similarity` or more, that link the components of all such pairs.

    A pair is compared exactly if its sketches agree in `alike` bytes. cross: sides 0 and 1, of which only pairs across count.
    """
    n = len(grams)
    label, sizes, out = np.arange(n), np.array([len(g) for g in grams]), []
    for i in range(n - 1):
        other = label[i + 1 :] != label[i]
        if cross is not None:
            other &= cross[i + 1 :] != cross[i]
        near = np.flatnonzero(other) + i + 1
        near = near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-6]
        if not len(near):
            continue
        agree = (sketches[near] == sketches[i]).sum(1)
        near = near[np.argsort(-agree, kind="stable")][: (agree >= alike).sum()]
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            small, large = (grams[i], grams[j]) if sizes[i] <= sizes[j] else (grams[j], grams[i])
            if not len(small):
                continue
            both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if both / (len(small) + len(large) - both) >= similarity:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def exact_links(docs: DataFrame, loose: DataFrame, width: int, similarity: float, alike: int) -> DataFrame:
    """Links (a, b) of Jaccard likeness `similarity` or more within each group of loose (id, doc_id, key, size, component).

    Only members of groups have their shingles hashed again. Small groups share tasks; a group of over EXACT_ROWS members or
    EXACT_SHINGLES shingles is compared block by block, so its rows are dealt out once for each of its blocks.
    """
    spark = docs.sparkSession
    groups = loose.groupBy(F.col("component").alias("of")).agg(F.ceil(F.greatest(F.count("*") / EXACT_ROWS, F.sum("size") / EXACT_SHINGLES, F.lit(1))).cast("int").alias("blocks"))
    total = loose.agg(F.sum("size")).first()[0] or 0
    rooms = max(partitions(spark), math.ceil(4 * total / EXACT_SHINGLES))
    members = loose.join(groups, F.col("component") == F.col("of")).select(F.col("id").alias("member"), F.col("doc_id").alias("at"), F.col("key").alias("text_key"), "component", "blocks")
    chosen = members.select("at", "text_key").distinct()
    texts = docs.select("doc_id", "text").join(chosen, (F.col("doc_id") == F.col("at")) & (text_key() == F.col("text_key")), "left_semi").dropDuplicates(["doc_id", "text"])
    dealt = shingle_sets(texts, width, whole=True).join(members, (F.col("doc_id") == F.col("at")) & (F.col("key") == F.col("text_key")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("room", F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(rooms))))
    dealt = dealt.select((F.col("blocks") > 1).alias("large"), "room", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), "component", "id", "sketch", "grams")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("component")
        ids, own = table["id"].to_numpy(), table["component"].to_numpy()
        second = table["second"].to_numpy(zero_copy_only=False) if key[2].as_py() != key[3].as_py() else None
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        grams = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        found = []
        ends = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            found += [(a + i, a + j) for i, j in alike_links(grams[a:b], sketches[a:b], similarity, alike, None if second is None else second[a:b])]
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return dealt.groupBy("large", "room", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.995) -> DataFrame:
    """(doc_id, key, component_id, component_key) of documents whose sets of word shingles are alike by `similarity` (Jaccard)
    or more; component_id and component_key are the doc_id and the text's hash of a component's first row in that order.

    Such pairs differ by about a seventh of the bits, too many for exact search, so the trees stand on random groups of
    bits, as many as reach `recall` for a pair at the threshold. Pairs that share a leaf are candidates if fingerprints and
    min-wise sketches are as near as those of nearly all pairs at the threshold (three and four standard deviations beyond
    the mean). Candidates only gather texts in loose groups; within a group a pair is linked by its exact likeness alone.
    Rows without a doc_id link to equal sets alone; texts without words are one component.
    """
    sets = materialise(shingle_sets(docs, width), "simhash")
    nodes = materialise(sets.groupBy("id").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")).select("id", "row.doc_id", "row.key", "size", "fp", "sketch"), "simhash-nodes")
    known = nodes.filter("doc_id is not null and size > 0")
    bits = max(6, math.ceil(math.log2(max(1, known.count()) / LEAF)) + 3)
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    trees = math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits))
    radius = math.ceil(64 * apart + 3 * math.sqrt(64 * apart * (1 - apart)))
    alike = math.floor(SKETCH * similarity - 4 * math.sqrt(SKETCH * similarity * (1 - similarity)))
    stars = connected_components(near_links(known, random_groups(trees, bits), 0, radius, alike))
    loose = materialise(known.select("id", "doc_id", "key", "size").join(stars, "id"), "loose")
    release(docs.sparkSession)
    stars = connected_components(exact_links(docs, loose, width, similarity, alike)).select(F.col("id").alias("of"), "component")
    named = nodes.select("id", "doc_id", "key").join(stars, F.col("id") == F.col("of"), "left").select("id", "doc_id", "key", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("row"))
    named = materialise(named.join(least, "component").select(F.col("id").alias("of"), F.col("row.doc_id").alias("component_id"), F.col("row.key").alias("component_key")), "named")
    release(docs.sparkSession)
    return sets.join(named, F.col("id") == F.col("of")).select("doc_id", "key", "component_id", "component_key")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, all columns: the smallest doc_id, and of rows that share it the text with the
    least hash; of rows that repeat both, the one whose columns have the least hash.

    Different texts of one doc_id that belong to different groups stay. Rows without a doc_id stay, all of them, and stand for
    no others. Extra columns pass through, but for names the operator uses inside (__*).
    """
    groups = near_duplicates(docs.filter("doc_id is not null"))
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("component_key"))
    kept = groups.filter(first).select(F.col("doc_id").alias("__kept"), F.col("key").alias("__key")).distinct()
    same = Window.partitionBy("doc_id", "__text").orderBy(F.xxhash64(*docs.columns))
    rows = docs.withColumn("__text", text_key()).join(kept, (F.col("doc_id") == F.col("__kept")) & (F.col("__text") == F.col("__key")), "left_semi")
    rows = rows.withColumn("__nth", F.row_number().over(same)).filter("__nth = 1").select(docs.columns)
    return rows.unionByName(docs.filter("doc_id is null"))
