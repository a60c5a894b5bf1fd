"""Packing along a space-filling curve: documents ordered by the Hilbert key of their projected vectors fill sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import encoder, materialise, partitions, with_text, word_bpe

WIDTH, END = 4096, 2
BUCKETS, DIMS, BITS, SEED = 1024, 3, 10, 5
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cell coordinates (n, dims), each below 2 ** bits."""
    x = cells.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections, from the largest cells down
        low = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def place(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, hilbert, n, ids): ids as 16-bit integers with the end id, and the key of the hashed, projected vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer, "<u2"), np.uint16(END).tobytes()
        axes = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))
        for batch in batches:
            held, spots, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.bytes(text) + end
                a = np.frombuffer(ids, "<u2").astype(np.uint64)
                v = np.sqrt(np.bincount(((a * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(22), minlength=BUCKETS))
                held.append(ids)
                sizes.append(len(a))
                spots.append(v @ axes / np.sqrt(v @ v))
            if held:
                cells = np.clip((np.array(spots) + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert_keys(cells, BITS)), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "hilbert", "n", "ids"])

    return with_text(docs).mapInArrow(run, "doc_id long, hilbert long, n long, ids binary")


def fill(documents: Iterator[tuple[int, np.ndarray]], width: int, first: int) -> Iterator[tuple]:
    """Pieces of documents in turn. Whole sequences have `width` ids; what is left at the end goes to sequences whose
    lengths are falling powers of two, so that nothing is padded."""
    held: list[list] = []  # [doc_id, start, ids, doc_tokens] of the open sequence
    room, sequence = width, first

    def rows(pieces: list, number: int) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at
            at += len(ids)

    for doc_id, ids in documents:
        start = 0
        while start < len(ids):
            part = ids[start : start + room]
            held.append([doc_id, start, part, len(ids)])
            start += len(part)
            room -= len(part)
            if not room:
                yield from rows(held, sequence)
                held, room, sequence = [], width, sequence + 1
    left = width - room
    while left:
        size = 1 << (left.bit_length() - 1)
        now, need = [], size
        while need:
            doc_id, start, ids, total = held[0]
            now.append([doc_id, start, ids[:need], total])
            if len(ids) > need:
                held[0] = [doc_id, start + need, ids[need:], total]
            else:
                held.pop(0)
            need -= len(now[-1][2])
        yield from rows(now, sequence)
        sequence, left = sequence + 1, left - size


def pack(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH) -> DataFrame:
    """The pieces of all documents in sequences of at most `width` ids, neighbours on the curve side by side.

    Null and empty texts have the end id alone; repeated rows are packed each; ties on the curve go by doc_id; a very long
    text is cut over as many sequences as it needs; extra columns are ignored; an empty table has no pieces.
    sequence_id counts up inside each partition of the range-sorted curve, from partition << 32.
    """
    placed = materialise(place(docs, tokenizer or word_bpe()), "placed")
    ranged = placed.repartitionByRange(partitions(docs.sparkSession), "hilbert", "doc_id", "n").sortWithinPartitions("hilbert", "doc_id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = ((i, np.frombuffer(x.as_buffer(), "<u2")) for b in batches for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        names, rows = [x.split()[0] for x in PIECES.split(", ")], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for row in fill(documents, width, TaskContext.get().partitionId() << 32):
            rows.append(row)
            if len(rows) == 50_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return ranged.select("doc_id", "ids").mapInArrow(run, PIECES)


