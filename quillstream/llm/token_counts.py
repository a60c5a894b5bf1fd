"""Token counts by offset-mapped attribution: whole documents are encoded once and spans of tokens joined to sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import encoder, with_text, word_bpe

SECTION = 1000
SCHEMA = "doc_id long, section long, start long, end long, n_tokens long"


def owners(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The section of each token span. Sections lie side by side from bounds[k] to bounds[k + 1].

    A token that crosses a boundary goes to the section that holds most of its characters, of equal ones to the first.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    for k in np.flatnonzero(first != last):
        s = np.arange(first[k], last[k] + 1)
        first[k] = s[np.argmax(np.minimum(ends[k], bounds[s + 1]) - np.maximum(starts[k], bounds[s]))]
    return first


def line_bounds(text: str, most: int = SECTION) -> np.ndarray:
    """Bounds of a text's lines (each with its line break), lines of over `most` characters cut after every `most`."""
    cuts, at = [0], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        cuts += [*range(at + most, end, most), end]
        at = end
    return np.unique(np.array(cuts, np.int64)) if text else np.zeros(2, np.int64)


class SpanEncoder:
    """Character spans of a text's tokens, word by word, with a bounded memo of each word's spans."""

    def __init__(self, path: str) -> None:
        outer, self.tokenizer = self, encoder(path).tokenizer

        class Memo(dict):
            def __missing__(self, word: bytes) -> tuple[int, bytes]:
                if len(self) >= 400_000:
                    self.clear()
                spans = outer.tokenizer.encode(word.decode(), add_special_tokens=False).offsets
                self[word] = found = (len(spans), np.array(spans, "<i4").reshape(-1, 2).tobytes())
                return found

        self.memo = Memo()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.memo.__getitem__, text.encode().split()))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        c = np.frombuffer(text.encode("utf-32-le"), "<u4")
        inside = ~((c == 32) | ((c >= 9) & (c <= 13)))
        begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        at = np.repeat(begins, [n for n, _ in found])
        own = np.frombuffer(b"".join([b for _, b in found]), "<i4").reshape(-1, 2)
        return at + own[:, 0], at + own[:, 1]


_spans: dict[str, SpanEncoder] = {}


def token_counts(docs: DataFrame, tokenizer: str | None = None, most: int = SECTION) -> DataFrame:
    """The tokens of each section of each document; a document's counts add up to the tokens of its whole text.

    Sections are lines, cut after every `most` code points. A null or empty text is one empty section without tokens.
    Repeated rows are counted each, extra columns ignored, an empty table gives no rows.
    """
    path = tokenizer or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _spans.setdefault(path, SpanEncoder(path))
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            ids = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bounds = line_bounds(text, most)
                starts, ends = coder.spans(text)
                n = len(bounds) - 1
                ids += [doc_id] * n
                for c, x in zip(cols, (np.arange(n), bounds[:-1], bounds[1:], np.bincount(owners(starts, ends, bounds), minlength=n) if len(starts) else np.zeros(n, np.int64)), strict=True):
                    c.append(x)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(np.concatenate(c)) for c in cols]], ["doc_id", "section", "start", "end", "n_tokens"])

    return with_text(docs).mapInArrow(run, SCHEMA)
