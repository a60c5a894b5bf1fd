"""Toxicity: class-conditional Kneser-Ney models over bytes, compared by log-likelihoods.

Each class has its own counts of the orders in ORDERS; both back off to one shared model of the order below, whose counts are
continuations in either class. An n-gram counts once a document and gives up DISCOUNT documents to its backoff, so a rare
expression, or one that a single document repeats, says nothing of its own. A text is scored by the length-normalised log
ratio of its two likelihoods, by those of the TOP words for which the classes differ most, and by its number of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import windows_of, with_text
from .labelled import held_out, sample

ORDERS, DISCOUNT, TOP, MOST, PRIME = (4, 6, 8), 2.0, 4, 20.0, 0x9E3779B97F4A7C15
EDGE, SHARED = ORDERS[-1], ORDERS[0] - 1
#: TOXIC_WEIGHT: how much all toxic rows weigh beside all others when scores are calibrated.
PER_CLASS, MAX_CHARS, TOXIC_WEIGHT, WINDOW = {0: 2200, 1: 1100}, 8192, 0.5, 1_000_000
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case words of a text between single spaces."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, EDGE spaces before each and one behind, and where each begins."""
    parts = [b" " * EDGE + t + b" " for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])[:-1]


def _hash_at(data: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the `order` bytes that end at some places."""
    out, p = np.zeros(len(at), np.uint64), 1
    for k in range(order):
        out += (data[at - k].astype(np.uint64) + np.uint64(1)) * np.uint64(p)
        p = p * PRIME & (2**64 - 1)
    return out


def _hashes(data: np.ndarray, orders: set[int]) -> dict[int, np.ndarray]:
    """The same hashes at every place, for several orders."""
    wide, p, found = data.astype(np.uint64) + np.uint64(1), 1, {}
    out = np.zeros(len(data), np.uint64)
    for k in range(max(orders)):
        out[k:] += wide[: len(wide) - k] * np.uint64(p)
        p = p * PRIME & (2**64 - 1)
        if k + 1 in orders:
            found[k + 1] = out.copy()
    return found


class _Counts:
    """Sums by key, looked up by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(inverse, values, len(self.keys)) if len(keys) else np.zeros(0)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.sums[i], 0.0)


class Table:
    """Values by 64-bit key, none lost: open addressing in at least four times as many slots, with 16 bits of the key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(4 * max(1, len(keys)) - 1).bit_length())
        self.value, self.check = np.zeros(1 << self.bits, np.float32), np.zeros(1 << self.bits, np.uint16)
        left, step = np.arange(len(keys)), 0
        slot, check = self.place(keys)
        while len(left):
            at = (slot[left] + step) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.check[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.check[at[put]], self.value[at[put]] = check[left[put]], values[left[put]]
            left = np.delete(left, put)
            step += 1
        self.steps = step

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64), (mixed & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found), 0 where not."""
        slot, check = self.place(keys)
        own = self.check[slot]
        hit = own == check
        out = np.where(hit, self.value[slot], np.float32(0))
        open_, step = np.flatnonzero(~hit & (own != 0)), 1
        while len(open_) and step < self.steps:
            at = (slot[open_] + step) & ((1 << self.bits) - 1)
            own = self.check[at]
            now = own == check[open_]
            out[open_[now]], hit[open_[now]] = self.value[at[now]], True
            open_, step = open_[~now & (own != 0)], step + 1
        return out, hit


def _ratio_tables(texts: list[bytes], labels: np.ndarray) -> dict[int, tuple[Table, Table]]:
    """For each order, the log ratio of the classes' probabilities of each n-gram that either class keeps beyond the discount,
    and of their backoff weights after each context."""
    data, begins = _joined(texts)
    size = np.diff(np.append(begins, len(data)))
    kinds: dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {0: {}, 1: {}}
    lowest = []
    for y in (0, 1):
        own = []
        for k in np.flatnonzero(labels == y):  # each n-gram of a document once
            at = np.arange(begins[k] + EDGE, begins[k] + size[k])
            own.append(at[np.unique(_hash_at(data, EDGE, at), return_index=True)[1]])
        at = np.concatenate(own)
        for k in reversed(ORDERS):  # below the highest order, the different continuations to the left count
            keys, first, count = np.unique(_hash_at(data, k, at), return_index=True, return_counts=True)
            at = at[first]
            kinds[y][k] = (keys, at, count)
        lowest.append(at)
    at = np.concatenate(lowest)
    at = at[np.unique(_hash_at(data, ORDERS[0], at), return_index=True)[1]]
    seen, total, one = _Counts(_hash_at(data, SHARED, at)), _Counts(_hash_at(data, SHARED - 1, at - 1)), np.bincount(data[at], minlength=256)

    def shared(p: np.ndarray) -> np.ndarray:
        return (seen.get(_hash_at(data, SHARED, p)) + 2 * (one[data[p]] + 0.5) / (len(at) + 128)) / (total.get(_hash_at(data, SHARED - 1, p - 1)) + 2)

    def model(y: int, k: int, lower: Callable) -> tuple[Callable, Callable]:
        keys, places, count = kinds[y][k]
        kept = np.maximum(count - DISCOUNT, 0.0)
        some, context = kept > 0, _hash_at(data, k - 1, places - 1)
        own, n, held = _Counts(keys[some], kept[some]), _Counts(context, count.astype(np.float64)), _Counts(context[some], kept[some])

        def backoff(p: np.ndarray) -> np.ndarray:
            c = _hash_at(data, k - 1, p - 1)
            return 1 - held.get(c) / np.maximum(n.get(c), 1)

        def probability(p: np.ndarray) -> np.ndarray:
            c = _hash_at(data, k - 1, p - 1)
            return own.get(_hash_at(data, k, p)) / np.maximum(n.get(c), 1) + backoff(p) * lower(p)

        return probability, backoff

    below, out = [shared, shared], {}
    for k in ORDERS:
        (p0, b0), (p1, b1) = (model(y, k, below[y]) for y in (0, 1))
        below = [p0, p1]
        kept = np.concatenate([kinds[y][k][1][kinds[y][k][2] > DISCOUNT] for y in (0, 1)])
        keys, first = np.unique(_hash_at(data, k, kept), return_index=True)
        contexts, after = np.unique(_hash_at(data, k - 1, kept - 1), return_index=True)
        out[k] = Table(keys, np.log(p1(kept[first]) / p0(kept[first]))), Table(contexts, np.log(b1(kept[after]) / b0(kept[after])))
    return out


class KneserNey:
    """The two models, as the log ratios that scoring needs, and the weights of the final logistic."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.weights = np.array([-2.0] + [0.0] * (TOP + 2))
        self.tables: dict[int, tuple[Table, Table]] = {}
        labels = np.array([y for y, _ in rows])
        texts = [plain(t) for _, t in rows]
        halves = [np.arange(len(rows)) % 2 == h for h in (0, 1)]
        if len(set(labels.tolist())) < 2:
            return
        if all(len(set(labels[h].tolist())) == 2 for h in halves):
            x = np.zeros((len(rows), TOP + 2))  # each half is measured by the counts of the other, as unseen texts are
            for h in halves:
                self.tables = _ratio_tables([t for t, own in zip(texts, ~h, strict=True) if own], labels[~h])
                x[h] = self.features([[t] for t, own in zip(texts, h, strict=True) if own])
            self._calibrate(x, labels)
        else:
            self.weights = np.array([-3.0, 0.0, *[0.5] * TOP, 0.0])
        self.tables = _ratio_tables(texts, labels)

    def _measures(self, texts: list[bytes]) -> np.ndarray:
        """(sum of ratios, bytes, words, the TOP largest ratios of words) of each text."""
        data, begins = _joined(texts)
        found = _hashes(data, {k - d for k in ORDERS for d in (0, 1)})
        ratio = np.zeros(len(data), np.float32)
        for k, (grams, contexts) in self.tables.items():
            own, known = grams.get(found[k])
            ratio[1:] += contexts.get(found[k - 1])[0][:-1]
            ratio = np.where(known, own, ratio)
        begins = np.append(begins, len(data))
        for k in range(EDGE):
            ratio[begins[:-1] + k] = 0
        out = np.zeros((len(texts), 3 + TOP))
        sums = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))
        out[:, 0], out[:, 1] = sums[begins[1:]] - sums[begins[:-1]], np.diff(begins) - EDGE
        space = data == 32
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if not len(starts):
            return out
        stops = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))  # the space after a word ends it
        word, own = sums[stops + 1] - sums[starts], np.searchsorted(begins, starts, "right") - 1
        out[:, 2] = np.bincount(own, minlength=len(texts))
        order = np.lexsort((-word, own))
        rank = np.arange(len(order)) - np.searchsorted(own[order], own[order], "left")
        for k in range(TOP):
            out[own[order[rank == k]], 3 + k] = word[order[rank == k]]
        return out

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """(ratio a byte, the TOP largest ratios of words up to MOST, log of words) of texts, each given as its windows."""
        if not self.tables or not texts:
            return np.zeros((len(texts), TOP + 2))
        parts = self._measures([w for t in texts for w in t])
        first = np.cumsum([0] + [len(t) for t in texts])[:-1]
        sums = np.add.reduceat(parts[:, :3], first)
        top = np.zeros((len(texts), TOP))
        for k, (a, t) in enumerate(zip(first, texts, strict=True)):
            top[k] = np.sort(parts[a : a + len(t), 3:], axis=None)[::-1][:TOP]
        return np.column_stack((sums[:, 0] / np.maximum(sums[:, 1], 1), np.minimum(top, MOST), np.log1p(sums[:, 2])))

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge, toxic rows together weighing TOXIC_WEIGHT of all others."""
        a, share = np.column_stack((np.ones(len(x)), x)), y.mean()
        each = np.where(y == 1, TOXIC_WEIGHT / share / 2, 1 / (1 - share) / 2)
        w = np.zeros(a.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (each * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
            w = w + np.linalg.solve(h, a.T @ (each * (y - p)) - 0.05 * w)
        self.weights = w

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts of over WINDOW characters are read in windows that end at white space and begin as texts do."""
        x = self.features([[plain(w) for w in windows_of(t, WINDOW)] for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> KneserNey:
    """Counts at most PER_CLASS labelled rows that aren't held out, of at most MAX_CHARS characters each."""
    return KneserNey(sample(docs, labels, "toxic", PER_CLASS, MAX_CHARS))


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document's whole text.

    Null and empty texts score what the model gives a text without evidence. Repeated rows score alike; extra columns are
    ignored; an empty table stays empty. The model's size is bounded by the sample that it was fitted on.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[float] = []
            part: list[str] = []
            size = 0
            for text in batch.column(1).to_pylist():
                part.append(text)
                size += len(text)
                if size >= WINDOW:
                    out += held.value.scores(part).tolist()
                    part, size = [], 0
            out += held.value.scores(part).tolist() if part else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(x, 6) for x in out], pa.float64())], ["doc_id", "score"])

    out = with_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
