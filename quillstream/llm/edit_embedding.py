"""Document fingerprints: a randomised edit embedding, bit-sampled, with banding and verification.

A shared random walk reads a text's characters: each stays under the walk for as many steps as shared random bits, indexed
by step and character, say, so an edit only shifts the walk until it falls back into step. Edit distance becomes Hamming
distance between walks. A fingerprint samples the walk at shared places, one bit a place. Places are chosen min-wise, so
that texts of unlike lengths sample the same place as often as the shorter walk covers the longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialise, with_text
from .components import connected_components
from .simhash import BLOCK

BITS, STEPS, SEED, BANDS = 256, 4096, 11, 16
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"


def _walk_tables() -> list[bytes]:
    """For each class of characters and step (mod STEPS), the steps until the walk moves on."""
    bits = np.random.default_rng(SEED).integers(0, 2, (256, STEPS)).astype(bool)
    bits[:, -1] = True
    out = np.zeros((256, STEPS), np.uint8)
    wait = np.zeros(256, np.int64)
    for j in range(2 * STEPS - 1, -1, -1):
        wait = np.where(bits[:, j % STEPS], 1, np.minimum(wait + 1, 255))
        if j < STEPS:
            out[:, j] = wait
    return [row.tobytes() for row in out]


def _places() -> np.ndarray:
    """For each bit, the falling records of a random hash over places, by simulation up to 2 ** 40; padded with 2 ** 62."""
    rng, rows = np.random.default_rng(SEED + 1), []
    for _ in range(BITS):
        at, least, row = 0, rng.random(), [0]
        while at < 2**40:
            at += int(rng.geometric(max(least, 1e-15)))
            least *= rng.random()
            row.append(at)
        rows.append(row)
    out = np.full((BITS, max(map(len, rows))), 2**62, np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


class Embedding:
    def __init__(self) -> None:
        self.tables, self.places = _walk_tables(), _places()
        self.salt = np.random.default_rng(SEED + 2).integers(1, 2**63, BITS, dtype=np.int64).astype(np.uint64)

    def walk(self, codes: np.ndarray, at: int = 0) -> np.ndarray:
        """Where the walk leaves each character, from place `at` on."""
        classes = ((codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()
        out, mask = [], STEPS - 1
        for row in map(self.tables.__getitem__, classes):
            at += row[at & mask]
            out.append(at)
        return np.array(out, np.int64)

    def sample(self, codes: np.ndarray, walk: np.ndarray) -> np.ndarray:
        """BITS bits of the walk, as bytes."""
        n = 2 * len(codes)
        k = np.maximum((self.places < n).sum(1) - 1, 0)
        place = self.places[np.arange(BITS), k]
        i = np.searchsorted(walk, place, "right")
        char = np.where(i < len(codes), codes[np.minimum(i, max(0, len(codes) - 1))], -1) if len(codes) else np.full(BITS, -1)
        mixed = (char.astype(np.int64).astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.salt
        mixed ^= mixed >> np.uint64(31)
        return np.packbits(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.uint8))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of fingerprints: 1 for equal ones, about 0 where bits agree by chance, near the share of the walk in common."""
    return max(0.0, 1.0 - 2.0 * int(np.bitwise_count(a ^ b).sum()) / BITS)


def bands_shared(a: np.ndarray, b: np.ndarray) -> int:
    return int((a.reshape(BANDS, -1) == b.reshape(BANDS, -1)).all(1).sum())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses (verification) with shared bands.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the document with
    the next doc_id, after the last the first. Null texts are empty; repeated ids are ordered by text; a single document is
    its own successor; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, names, held = Embedding(), [x.split()[0] for x in COLUMNS.split(", ")], None
        for batch in batches:
            rows = []
            for doc_id, text, part, guard in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                codes = codes_of(text)
                walk = e.walk(codes)
                own = e.sample(codes, walk)
                if held is not None and held[5] == part:
                    before, was_codes, was_walk, was, was_text, _ = held
                    half = len(was_codes) // 2
                    keep = len(was_codes) - half
                    edited = was_text[:keep] + text[:half]
                    more = codes[:half]
                    joined = np.concatenate((was_codes[:keep], more))
                    path = np.concatenate((was_walk[:keep], e.walk(more, int(was_walk[keep - 1]) if keep else 0)))
                    new = e.sample(joined, path)
                    rows.append((before, len(was_codes), hashlib.sha256(edited.encode()).hexdigest(), was.tobytes().hex(), new.tobytes().hex(), likeness(was, new), likeness(was, own), bands_shared(was, new), bands_shared(was, own)))
                held = None if guard else (doc_id, codes, walk, own, text, part)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return in_order(with_text(docs), guard=True).select("doc_id", "text", "part", "guard").mapInArrow(run, COLUMNS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) with 64 hex digits, a row each document; a null text is an empty one, extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Embedding()
        for batch in batches:
            found = [e.sample(c, e.walk(c)).tobytes().hex() for c in map(codes_of, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return with_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edit_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id): fingerprints that share a band and verify at `least` likeness link, transitively.

    Equal fingerprints are one node. A crowded band bucket is compared block by block and gives spanning links alone. Rows
    without an id link others as any row does; component_id is the least id of a group, null where none has one. Repeated rows
    and rows that share an id each have their own, null texts are empty, extra columns are ignored, no rows give none.
    """
    fps = materialise(fingerprints(docs), "edits")
    # numbered before they are written, so that a number stays with its fingerprint
    nodes = materialise(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "edit-nodes")
    digits = BITS // 4 // BANDS
    bands = nodes.withColumn("band", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("k"), F.col("fingerprint").substr(k * digits + 1, F.lit(digits)).alias("value"))))).select("band.k", "band.value", "id", "fingerprint")
    sizes = bands.groupBy("k", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = bands.join(sizes, ["k", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "fingerprint")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        fps = np.frombuffer(bytes.fromhex("".join(table["fingerprint"].to_pylist())), np.uint64).reshape(len(ids), -1)
        label, out = np.arange(len(ids)), []
        for i in range(len(ids)):
            near = np.flatnonzero(label != label[i])
            near = near[np.bitwise_count(fps[near] ^ fps[i]).sum(1) <= BITS * (1 - least) / 2]
            if len(near):
                roots, first = np.unique(label[near], return_index=True)
                out += [(int(ids[i]), int(ids[near[f]])) for f in first]
                label[np.isin(label, roots)] = label[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    links = dealt.groupBy("k", "value", "low", "high").applyInArrow(compare, "a long, b long")
    stars = connected_components(links).select(F.col("id").alias("at"), "component")
    named = nodes.join(stars, F.col("id") == F.col("at"), "left").select(F.col("fingerprint").alias("of"), F.coalesce("component", "id").alias("component"), "least")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.drop("least").join(ids, "component"), F.col("fingerprint") == F.col("of"), "left").select("doc_id", "component_id")
