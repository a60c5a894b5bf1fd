"""Token-id output: whole documents as ids in Parquet files of range-coded, checksummed blocks, and their reader.

The file format: one row a block, in ascending order of documents: part and block number, first id's place in the part,
number of ids, a CRC-32, the payload and the prior (see range_coder), and the pieces of documents that the block holds
(doc_id, the piece's place in its document, its length, the ids of its document). Each row decodes by itself; rows coded
together have equal priors, which Parquet's dictionaries keep once. The CRC-32 is over the ids as little-endian unsigned
32-bit integers, then the pieces, so damage to any of them or to what they are decoded from shows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, in_chunks, in_order, with_text, word_bpe
from .range_coder import decode_blocks, encode_blocks

END, BLOCK, LANES = 1, 2048, 4096
PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
FILE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary()), ("prior", pa.binary()), ("pieces", pa.list_(PIECE))])
FILE_DDL = "part int, block long, first long, n_ids long, crc32 long, payload binary, prior binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint>>"


def checksum(ids: np.ndarray, pieces: list[dict]) -> int:
    """CRC-32 of a block's ids and then of its pieces, each four 64-bit integers (a null doc_id as the least)."""
    marks = np.array([(-(2**63) if p["doc_id"] is None else p["doc_id"], p["start"], p["length"], p["doc_tokens"]) for p in pieces], "<i8")
    return zlib.crc32(marks.tobytes(), zlib.crc32(ids.astype("<u4").tobytes()))


class _Part:
    """Fills blocks of one part with documents in turn."""

    def __init__(self, part: int) -> None:
        self.part, self.first, self.number = part, 0, 0
        self.blocks: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.pieces: list[dict] = []
        self.room = BLOCK

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            cut = ids[start : start + self.room]
            self.ids.append(cut)
            self.pieces.append({"doc_id": doc_id, "start": start, "length": len(cut), "doc_tokens": len(ids)})
            start += len(cut)
            self.room -= len(cut)
            if not self.room:
                self.close()

    def close(self) -> None:
        if self.ids:
            self.blocks.append((self.number, self.first, np.concatenate(self.ids), self.pieces))
            self.first += BLOCK - self.room
            self.number += 1
            self.ids, self.pieces, self.room = [], [], BLOCK

    def coded(self) -> pa.RecordBatch:
        payloads, prior = encode_blocks([b[2] for b in self.blocks])
        rows = []
        for (k, first, ids, pieces), x in zip(self.blocks, payloads, strict=True):
            rows.append({"part": self.part, "block": k, "first": first, "n_ids": len(ids), "crc32": checksum(ids, pieces), "payload": x, "prior": prior, "pieces": pieces})
        self.blocks = []
        return pa.RecordBatch.from_pylist(rows, FILE)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows of the file format for all documents, the end id after each; null texts are empty, null ids come first."""
    path = tokenizer or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now = encoder(path, "<u2"), None

        def rows() -> Iterator[tuple[int | None, int, np.ndarray]]:
            for batch in batches:
                keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
                for texts in in_chunks(batch.column(1)):
                    ids, sizes = coder.many(texts)
                    ends = np.cumsum(sizes)
                    ids, ends = np.insert(ids, ends, END), ends + np.arange(1, len(ends) + 1)
                    for (doc_id, part), n, to in zip(itertools.islice(keys, len(texts)), (sizes + 1).tolist(), ends.tolist(), strict=True):
                        yield doc_id, part, ids[to - n : to]

        for doc_id, part, ids in rows():
            if now is None or part != now.part:
                if now is not None:
                    now.close()
                    yield now.coded()
                now = _Part(part)
            now.add(doc_id, ids)
            if len(now.blocks) >= LANES:
                yield now.coded()
        if now is not None:
            now.close()
            yield now.coded()

    return in_order(with_text(docs)).select("doc_id", "text", F.col("part").cast("int").alias("part")).mapInArrow(run, FILE_DDL)


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes encode()'s rows to path, over what is there.

    Null and empty texts have the end id alone; null ids come first; repeated rows are written each; extra columns are ignored;
    an empty table gives files without rows. A very long text goes on over as many blocks as it needs.
    """
    encode(docs, tokenizer).write.mode("overwrite").parquet(path)


def _times(a: int, b):
    """Product of a polynomial and one or an array of others modulo that of CRC-32, bits reversed."""
    out = b & 0
    for k in range(31, -1, -1):
        if (a >> k) & 1:
            out = out ^ b
        b = (b >> 1) ^ ((b & 1) * 0xEDB88320)
    return out


_squares = [1 << 30]  # x ** (2 ** k)
while len(_squares) < 64:
    _squares.append(_times(_squares[-1], _squares[-1]))


def crcs_before(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each piece's CRC-32 adds, by exclusive or, to that of the piece followed by n_bytes more."""
    out, n = crcs.astype(np.int64), 8 * n_bytes.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        go = np.flatnonzero((n >> k) & 1)
        out[go] = _times(_squares[k], out[go])
    return out


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, part, at, start, length, doc_tokens, crc, ids) of each piece, decoded; `at` is its place in the part.

    A block whose checksum differs, or that doesn't decode, fails the read. `crc` of a document's pieces combine by
    exclusive or into the CRC-32 of its ids as little-endian unsigned 32-bit integers. ids are those 16-bit ids as bytes;
    without them, blocks are decoded and checked all the same.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), *[(x, pa.int64()) for x in ("at", "start", "length", "doc_tokens", "crc")], *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_prior: dict[bytes, list[dict]] = {}
            for r in batch.to_pylist():
                by_prior.setdefault(r["prior"], []).append(r)
            for prior, of in by_prior.items():
                for at in range(0, len(of), LANES):
                    yield pieces_of(prior, of[at : at + LANES])

    def pieces_of(prior: bytes, rows: list[dict]) -> pa.RecordBatch:
        out = []
        for r, ids in zip(rows, decode_blocks([r["payload"] for r in rows], [r["n_ids"] for r in rows], prior), strict=True):
            wide, offset = ids.astype("<u4"), 0
            if checksum(wide, r["pieces"]) != r["crc32"]:
                raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
            for p in r["pieces"]:
                to = offset + p["length"]
                row = (p["doc_id"], r["part"], r["first"] + offset, p["start"], p["length"], p["doc_tokens"], zlib.crc32(wide[offset:to]))
                out.append((*row, ids[offset:to].astype("<u2").tobytes()) if with_ids else row)
                offset = to
        cols = list(zip(*out, strict=True)) or [()] * len(schema)
        start, length, tokens, crc = (np.array(cols[k], np.int64) for k in (3, 4, 5, 6))
        cols[6] = crcs_before(crc, 4 * (tokens - start - length))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema.types, strict=True)], schema.names)

    files = spark.read.schema(FILE_DDL).parquet(path)
    return files.mapInArrow(run, "doc_id long, part int, at long, start long, length long, doc_tokens long, crc long" + ", ids binary" * with_ids)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, a row for each row that was written."""
    files = spark.read.schema(FILE_DDL).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a part
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["n"]
    before = spark.createDataFrame(offsets, "part int, before long")
    pieces = read_pieces(spark, path, with_ids=False).select("doc_id", "part", (F.col("at") - F.col("start")).alias("begin"), "length", "crc")
    found = pieces.groupBy("part", "begin", "doc_id").agg(F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
