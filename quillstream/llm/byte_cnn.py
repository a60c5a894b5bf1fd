"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters eight bytes wide look at every fourth byte; their outputs are max-pooled inside chunks that
overlap by half and cover the whole document; the mean and the maximum over chunks make one logistic probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, with_text
from .labelled import held_out, sample

EMBED, FILTERS, STRIDE, HALF = 8, 24, 4, 64  # HALF: windows in half a chunk
PER_CLASS, MAX_CHARS, EPOCHS, RATE, BATCH, SEED, THRESHOLD = {0: 1200, 1: 1800}, 16_384, 14, 0.01, 64, 3, 0.3
#: Bytes of a long text that are looked at together: whole half chunks.
SEGMENT = HALF * STRIDE * 4096
Weights = dict[str, np.ndarray]


def _padded(text: bytes) -> bytes:
    """A text padded to whole blocks and one more, so that the last window ends."""
    return text + bytes(-len(text) % STRIDE + STRIDE * (1 + (len(text) == 0)))


def _blocks(padded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in blocks of STRIDE, windows a text) of padded texts."""
    return np.frombuffer(b"".join(padded), np.uint8).reshape(-1, STRIDE), np.array([len(p) // STRIDE - 1 for p in padded])


def _pooled(w: Weights, blocks: np.ndarray, windows: np.ndarray, where: bool = False):
    """Maxima of half chunks, the half chunks of each text, and the window that gave each maximum if asked for."""
    e = w["embed"][blocks].reshape(len(blocks), -1)
    k = STRIDE * EMBED
    y = e @ w["filters"][:k]
    y[:-1] += (e @ w["filters"][k:])[1:]
    first = np.concatenate(([0], np.cumsum(windows + 1)[:-1]))
    y[first + windows] = -1e9  # the block after a text belongs to no window
    halves = -(-windows // HALF)
    starts = np.concatenate([f + HALF * np.arange(h) for f, h in zip(first, halves, strict=True)])
    top = np.maximum.reduceat(y, starts, axis=0)
    at = None
    if where:
        ends = np.append(starts[1:], len(y))
        at = np.stack([s + y[s:t].argmax(0) for s, t in zip(starts, ends, strict=True)])
    return top, halves, at


def _features(top: np.ndarray, halves: np.ndarray, bias: np.ndarray):
    """Mean and maximum over overlapping chunks (pairs of neighbouring half chunks), with the way back to half chunks."""
    first = np.concatenate(([0], np.cumsum(halves)[:-1]))
    last = np.zeros(len(top), bool)
    last[first + halves - 1] = True
    last[first[halves == 1]] = False  # a single half chunk is a chunk
    nxt = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
    nxt[first[halves == 1]] = first[halves == 1]
    use = np.flatnonzero(~last)
    other = nxt[use]
    right = top[other] > top[use]
    source = np.where(right, other[:, None], use[:, None])
    chunk = np.maximum(np.take_along_axis(top, source, 0) + bias, 0)
    counts = np.maximum(halves - 1, 1)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.concatenate((np.add.reduceat(chunk, begin, axis=0) / counts[:, None], np.maximum.reduceat(chunk, begin, axis=0)), 1), chunk, source, counts, begin


def _segments(padded: bytes) -> list[bytes]:
    """A long padded text in segments of SEGMENT bytes and one block more, so that their windows in turn are those of the whole."""
    cuts = range(0, max(1, len(padded) - SEGMENT // 2), SEGMENT)
    return [padded[a : a + SEGMENT + STRIDE] for a in cuts[:-1]] + [padded[cuts[-1] :]]


def probabilities(w: Weights, texts: list[bytes]) -> np.ndarray:
    """The probability of each whole text; at most a few segments are under the filters at a time."""
    tops, counts = [], np.zeros(len(texts), np.int64)
    pieces = ((k, x) for k, t in enumerate(texts) for x in _segments(_padded(t)))
    for part in chunks(pieces, lambda r: 4 * len(r[1])):
        blocks, windows = _blocks([x for _, x in part])
        top, halves, _ = _pooled(w, blocks, windows)
        tops.append(top)
        np.add.at(counts, [k for k, _ in part], halves)
    f = _features(np.concatenate(tops), counts, w["bias"])[0]
    return 1 / (1 + np.exp(-np.clip(f @ w["out"][:-1] + w["out"][-1], -30, 30)))


def train(rows: list[tuple[int, str]]) -> Weights:
    """Fits the network by Adam on the log loss; without rows of both labels every score is that of the labels' mean."""
    rng = np.random.default_rng(SEED)
    w = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.15, (2 * STRIDE * EMBED, FILTERS)), "bias": np.zeros(FILTERS), "out": np.zeros(2 * FILTERS + 1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    labels = np.array([y for y, _ in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        w["out"][-1] = 0 if not len(labels) else (4 if labels[0] else -4)
        return w
    texts = [t.encode() for _, t in rows]
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    share = np.where(labels == 1, share * 0.9, share * 1.1).astype(np.float32)
    first, second, step, k = {n: np.zeros_like(v) for n, v in w.items()}, {n: np.zeros_like(v) for n, v in w.items()}, 0, STRIDE * EMBED
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            blocks, windows = _blocks([_padded(texts[i]) for i in pick])
            top, halves, at = _pooled(w, blocks, windows, where=True)
            f, chunk, source, counts, begin = _features(top, halves, w["bias"])
            p = 1 / (1 + np.exp(-np.clip(f @ w["out"][:-1] + w["out"][-1], -30, 30)))
            slope = ((p - labels[pick]) * share[pick] / len(pick)).astype(np.float32)
            g = {"out": np.append(f.T @ slope, slope.sum()) + 1e-4 * w["out"]}
            back = slope[:, None] * w["out"][None, :-1]
            d = np.repeat(back[:, :FILTERS] / counts[:, None], counts, 0)
            d += np.repeat(back[:, FILTERS:], counts, 0) * (chunk == np.repeat(f[:, FILTERS:], counts, 0))
            d *= chunk > 0
            g["bias"] = d.sum(0)
            window = np.take_along_axis(at, source, 0)  # of each chunk and filter
            pair = np.concatenate((blocks[window], blocks[window + 1]), 2)  # chunk, filter, byte
            e = w["embed"][pair].reshape(*pair.shape[:2], -1)
            g["filters"] = np.einsum("cfk,cf->kf", e, d, optimize=True)
            de = (d[:, :, None] * w["filters"].T[None]).reshape(-1, EMBED)
            flat = pair.reshape(-1)
            g["embed"] = np.stack([np.bincount(flat, de[:, j], minlength=256) for j in range(EMBED)], 1)
            step += 1
            for n in w:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                w[n] = (w[n] - RATE * (1 - epoch / EPOCHS) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Weights:
    """Trains on at most PER_CLASS labelled rows that aren't held out, of at most MAX_CHARS characters each."""
    return train(sample(docs, labels, "quality", PER_CLASS, MAX_CHARS))


def _scores(w: Weights, texts: list[str]) -> list[float]:
    out: list[float] = []
    for part in chunks(((t.encode(),) for t in texts), lambda r: 4 * len(r[0])):
        out += probabilities(w, [r[0] for r in part]).tolist()
    return [round(x, 6) for x in out]


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document's whole text; null texts are empty, repeated rows score alike,
    a long text is read in segments that share nothing but what the filters need.

    The weights are a few tens of KB, whatever the input's size. Extra columns are ignored; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(held.value, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    out = with_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: Weights) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score THRESHOLD or more."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array([s >= THRESHOLD for s in _scores(held.value, texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
