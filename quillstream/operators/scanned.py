"""All findings of a document and all sums of its metrics in one look at its words.

Spark deals the documents out and cuts them; a task takes the words of some documents as numbers, so that what is asked of a word
(its folded form, stem, syllables, class) is found once for each different word and no sentence is a row of its own. The rules
are those of the analyses, which tests compare.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from .frames import Frames
from .inside import _codes, _lists, _previous, repeated

#: Words that are looked at together; a longer document is looked at alone.
WORDS = 400_000
FINDINGS = "rule string, message string, sent long, pos long, n long, distance long"


class Phrases:
    """Phrases of words as a tree: from a state and a word's number to the next state; a state may end a phrase."""

    def __init__(self, phrases: Iterable[str]) -> None:
        entries = sorted({tuple(p.lower().split()) for p in phrases} - {()})
        self.vocabulary = sorted({w for p in entries for w in p})
        number, steps, self.ends = {w: k for k, w in enumerate(self.vocabulary)}, {}, [None]
        for p in entries:
            state = 0
            for w in p:
                key = state * len(number) + number[w]
                if key not in steps:
                    steps[key] = len(self.ends)
                    self.ends.append(None)
                state = steps[key]
            self.ends[state] = " ".join(p)
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.to = np.array([steps[k] for k in sorted(steps)], dtype=np.int64)
        self.closed = np.array([e is not None for e in self.ends])
        self.longest = max(map(len, entries), default=0)

    def found(self, of: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, state) of the longest matches from the left that don't overlap, inside sentences."""
        number = np.asarray(pc.fill_null(pc.index_in(of.kinds, value_set=pa.array(self.vocabulary, pa.string())), -1), dtype=np.int64)
        words = number[of.code]
        at = np.flatnonzero(words >= 0)
        state = np.zeros(len(at), dtype=np.int64)
        size, last = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for n in range(1, self.longest + 1):
            held = of.left[at] >= n
            at, state = at[held], state[held]
            word = words[at + n - 1]
            key = state * len(self.vocabulary) + word
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = (word >= 0) & (self.keys[place] == key)
            at, state = at[held], self.to[place[held]]
            ended = self.closed[state]
            size[at[ended]], last[at[ended]] = n, state[ended]
        at = np.flatnonzero(size)
        at = at[_apart(at, at + size[at])]
        return at, size[at], last[at]


def _apart(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the stretches, in order of their start, are left if each goes that begins inside one that stays."""
    keep = np.ones(len(start), dtype=bool)
    if (start[1:] < end[:-1]).any():
        upto = -1
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            if a < upto:
                keep[k] = False
            else:
                upto = b
    return keep


def _ascii(words: pa.Array) -> np.ndarray:
    return np.asarray(pc.equal(pc.binary_length(words), pc.utf8_length(words)))


def _folded(words: pa.Array, marks: bool = True) -> pa.Array:
    """text.fold() of each word; without `marks`, lower case alone."""
    wide = ~_ascii(words)
    lower = pc.ascii_lower(words)
    if not wide.any():
        return lower
    table = str.maketrans("’‘ʼ‐‑", "'''--") if marks else {}
    return pc.replace_with_mask(lower, pa.array(wide), pa.array([w.lower().translate(table) for w in words.filter(pa.array(wide)).to_pylist()], pa.string()))


def _one_of(words: pa.Array, entries: Iterable[str]) -> np.ndarray:
    return np.asarray(pc.is_in(words, value_set=pa.array(sorted(set(entries)), pa.string())))


def _capitalised(words: pa.Array) -> np.ndarray:
    """text.is_capitalised() of each word."""
    out, wide = np.asarray(pc.match_substring_regex(words, "^[A-Z]")).copy(), np.flatnonzero(~_ascii(words))
    out[wide] = [w[:1].isupper() for w in words.take(pa.array(wide)).to_pylist()]
    return out


def _stem(w: str) -> str:
    """text.stem() of a word that ends in s."""
    w = w.removesuffix("'s")
    if len(w.encode()) <= 3 or not w.endswith("s"):
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith(("sses", "ches", "shes", "xes")):
        return w[:-2]
    return w if w.endswith(("ss", "us", "is")) else w[:-1]


def _stems(words: pa.Array) -> pa.Array:
    plural = pc.ends_with(words, "s")
    return pc.replace_with_mask(words, plural, pa.array([_stem(w) for w in words.filter(plural).to_pylist()], pa.string()))


def _syllables(words: pa.Array) -> np.ndarray:
    """text.syllable_count() of each word."""
    lower = _folded(words, False)
    w = pc.replace_substring_regex(lower, "[^a-z]", "")
    has = lambda pattern: np.asarray(pc.match_substring_regex(w, pattern))
    silent = (has("es$") & ~has("(s|z|c|g|x|sh|ch)es$")) | (has("ed$") & ~has("[td]ed$"))
    mute = has("e$") & ~has("(le|ee)$")
    short = np.asarray(pc.binary_length(w)) <= 3
    cut = pc.if_else(pa.array(silent), pc.utf8_slice_codeunits(w, 0, -2), pc.if_else(pa.array(mute), pc.utf8_slice_codeunits(w, 0, -1), w))
    cut = pc.if_else(pc.starts_with(w, "y"), pc.utf8_slice_codeunits(cut, 1), cut)
    n = np.where(short, 1, np.maximum(np.asarray(pc.count_substring_regex(cut, "[aeiouy]+")), 1))
    known = np.asarray(pc.fill_null(pc.index_in(lower, value_set=pa.array(list(V.SYLLABLE_EXCEPTIONS), pa.string())), -1))
    return np.where(known >= 0, np.array([int(x) for x in V.SYLLABLE_EXCEPTIONS.values()])[known], n)


def _letters(words: pa.Array) -> np.ndarray:
    """text.letters() of each word of Latin script."""
    plain = np.asarray(pc.match_substring_regex(words, "^[A-Za-z0-9]*$"))
    out = np.asarray(pc.utf8_length(words)).copy()
    out[~plain] = [sum(c.isalpha() or unicodedata.category(c)[0] == "N" for c in w) for w in words.filter(pa.array(~plain)).to_pylist()]
    return out


class Scan:
    """The words and sentences of a batch (words array<string>, sizes array<int>, regions array<int>) as numbers.

    By word: code (of its folded form in kinds), spelt (of its form in forms), row, at (its place in the document), left (words up to its
    sentence's end, itself included), sent. By sentence: size, first (word), of (row), nth, region.
    """

    def __init__(self, words: pa.ListArray, sizes: pa.ListArray, regions: pa.ListArray) -> None:
        values, self.row, self.at, self.sizes = _lists(words)
        marked, kinds = _codes(values)
        self.spoken = np.asarray(pc.starts_with(kinds, T.SPOKEN), dtype=bool)[marked]
        spelt, self.forms = _codes(pc.replace_substring(kinds, T.SPOKEN, ""))
        self.spelt = spelt[marked]
        code, self.kinds = _codes(_folded(self.forms))
        self.code = code[self.spelt]
        size, self.of, self.nth, self.sentences = _lists(sizes)
        self.size = np.asarray(size, dtype=np.int64)
        self.region = np.asarray(regions.flatten(), dtype=np.int64)
        ends = np.cumsum(self.size)
        self.first = ends - self.size
        self.sent = np.repeat(np.arange(len(self.size)), self.size)
        self.left = ends[self.sent] - np.arange(len(self.code))

    def total(self, by_word: np.ndarray) -> np.ndarray:
        """Sums of a number a word, by row."""
        upto, ends = np.concatenate(([0], np.cumsum(by_word, dtype=np.int64))), np.cumsum(self.sizes)
        return upto[ends] - upto[ends - self.sizes]

    def echoes(self, window: int = 50, min_length: int = 4, ignore: Iterable[str] = ()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(word, distance, stem) of analyses.echoes()."""
        content = np.asarray(pc.greater_equal(pc.utf8_length(self.kinds), min_length)) & ~_one_of(self.kinds, [*V.STOPWORDS, *ignore])
        held = np.flatnonzero(content[self.code])
        _, group = np.unique(self.row[held] * max(len(self.kinds), 1) + self.code[held], return_inverse=True)
        inner = self.first[self.sent[held]] < held
        upper = _capitalised(self.forms)[self.spelt[held]]
        count = lambda flag: np.bincount(group, flag) if len(group) else np.zeros(0)
        name = ((count(inner & upper) > 0) & (count(inner & ~upper) == 0))[group]
        held = held[~name]
        stem, stems = _codes(_stems(self.kinds.filter(pa.array(content))))
        of = np.zeros(len(content), dtype=np.int64)
        of[content] = stem
        code = of[self.code[held]]
        before = _previous(self.row[held] * max(len(stems), 1) + code, self.at[held])
        distance = self.at[held] - before
        near = (before >= 0) & (distance <= window)
        return held[near], distance[near], stems.take(pa.array(code[near]))

    def adverbs(self) -> np.ndarray:
        adverb = np.asarray(pc.and_(pc.ends_with(self.kinds, "ly"), pc.greater(pc.binary_length(self.kinds), 4))) & ~_one_of(self.kinds, V.NOT_ADVERBS)
        return np.flatnonzero(adverb[self.code])

    def passives(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words) of analyses.passive(): a be-verb, at most one -ly word, a participle, and a `by` after it."""
        be, adjective = _one_of(self.kinds, V.BE_VERBS), _one_of(self.kinds, V.ADJECTIVAL_PARTICIPLES)
        participle = _one_of(self.kinds, V.IRREGULAR_PARTICIPLES) | np.asarray(pc.and_(pc.ends_with(self.kinds, "ed"), pc.greater(pc.binary_length(self.kinds), 3)))
        by, ly = _one_of(self.kinds, ["by"]), np.asarray(pc.ends_with(self.kinds, "ly"))
        kind = np.select([be & participle, be, adjective, participle, by, ly], list(b"Bbapyl"), 0).astype(np.uint8)
        k = np.concatenate((kind[self.code], np.zeros(3, dtype=np.uint8)))
        at = np.flatnonzero((k[:-3] == ord("b")) | (k[:-3] == ord("B")))
        left, to = self.left[at], at + 1 + (k[at + 1] == ord("l"))
        agent = (k[to + 1] == ord("y")) & (left > to + 1 - at)
        hit = (left > to - at) & ((k[to] == ord("p")) | (k[to] == ord("B")) | ((k[to] == ord("a")) & agent))
        at, n = at[hit], (to - at + 1 + agent)[hit]
        keep = _apart(at, at + n)
        return at[keep], n[keep]

    def opener_runs(self, run: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, sentences) of runs that open with one word, in a section."""
        order = np.lexsort((self.nth, self.region, self.of))
        word, of, region = self.code[self.first[order]], self.of[order], self.region[order]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1]) | (region[1:] != region[:-1])))) if len(order) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.append(new, len(order)))
        return order[new[n >= run]], n[n >= run]

    def even_runs(self, run: int = 4, tolerance: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, sentences) of analyses.monotony()."""
        order = np.lexsort((self.nth, self.region, self.of))
        of, region, out = self.of[order], self.region[order], []
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (region[1:] != region[:-1]))) if len(order) else np.zeros(0, dtype=bool)
        first, n, lo, hi, held = 0, 0, 0, 0, []
        for k, (y, fresh) in enumerate(zip(self.size[order].tolist(), new.tolist(), strict=True)):
            if not fresh:
                low, high = (y if y < lo else lo), (y if y > hi else hi)
                if high - low <= tolerance:
                    n, lo, hi = n + 1, low, high
                    if n < run:
                        held.append(y)
                    continue
                if n < run:
                    low, high, t = y, y, 0  # the longest end that the length fits goes on
                    for h in reversed(held):
                        low, high = min(low, h), max(high, h)
                        if high - low > tolerance:
                            break
                        t, lo, hi = t + 1, low, high
                    if t:
                        first, n, held = k - t, t + 1, [*held[-t:], y]
                        continue
            if n >= run:
                out.append((first, n))
            first, n, lo, hi, held = k, 1, y, y, [y]
        if n >= run:
            out.append((first, n))
        return order[np.array([a for a, _ in out], dtype=np.int64)], np.array([n for _, n in out], dtype=np.int64)


def _input(f: Frames) -> list:
    """The columns of a Scan, out of `sents`."""
    return [F.flatten(F.transform("sents", lambda s: s["words"])).alias("words"), F.transform("sents", lambda s: F.size(s["words"])).alias("sizes"), F.transform("sents", lambda s: F.coalesce(s["section"], F.lit(-1))).alias("regions")]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose words (the second column) are about WORDS at most."""
    for batch in batches:
        upto, at = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), dtype=np.int64)), 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def _rules(lists: dict[str, Iterable[str]]) -> dict[str, Phrases]:
    made = {rule: Phrases(phrases) for rule, phrases in lists.items()}
    return {rule: p for rule, p in made.items() if p.longest}


def findings(f: Frames, lists: dict[str, Iterable[str]], verbs: dict[str, str] | None = None, runs: bool = False, echoes: int = 0, each: int = 0) -> DataFrame:
    """(doc_id, rule, message, sent, pos, n, distance) of phrases (by rule), adverbs and passives; with `runs`, also of repeated
    openers, even rhythm and long sentences, at their first sentence and word; with `echoes`, a window of so many words, also of
    those, which have a distance.

    verbs: what the message of rule `nominal` also names, by its words. each: only so many of a rule and document come, echoes by
    distance and all else by place; the first one's `hidden` says how many more there are.
    """
    rules, verbs, schema = _rules(lists), verbs or {}, FINDINGS + ", hidden long" * bool(each)

    def found(of: Scan) -> Iterator[tuple]:
        """(rule, messages, first words, words, distances)"""
        for rule, phrases in rules.items():
            at, n, state = phrases.found(of)
            named = [f"{e} -> {verbs[e]}" if rule == "nominal" and e in verbs else e for e in phrases.ends]
            yield rule, pa.array(named, pa.string()).take(pa.array(state)), at, n, None
        at = of.adverbs()
        yield "adverbs", of.kinds.take(pa.array(of.code[at])), at, np.ones(len(at), dtype=np.int64), None
        at, n = of.passives()
        longest = int(n.max(initial=0))
        words = [of.kinds.take(pa.array(of.code[np.minimum(at + k, len(of.code) - 1)], mask=k >= n)) for k in range(longest)]
        yield "passive", pc.binary_join_element_wise(*words, " ", null_handling="skip") if longest else pa.array([], pa.string()), at, n, None
        if runs:
            which, n = of.opener_runs()
            words = of.kinds.take(pa.array(of.code[of.first[which]])).to_pylist()
            yield "starters", pa.array([f"{w} opens {k} sentences" for w, k in zip(words, n.tolist(), strict=True)], pa.string()), of.first[which], of.size[which], None
            which, n = of.even_runs()
            yield "monotony", pa.array([f"{k} sentences of like length" for k in n.tolist()], pa.string()), of.first[which], of.size[which], None
            which = np.flatnonzero(of.size > 40)
            yield "long-sentence", pa.array([f"{k} words" for k in of.size[which].tolist()], pa.string()), of.first[which], of.size[which], None
        if echoes:
            at, distance, stems = of.echoes(echoes)
            yield "echo", stems, at, np.ones(len(at), dtype=np.int64), distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            of = Scan(*batch.columns[1:])
            for rule, messages, at, n, distance in found(of):
                hidden = []
                if each:
                    order = np.lexsort((of.at[at], np.zeros(len(at)) if distance is None else distance, of.row[at]))
                    row, count = of.row[at][order], np.bincount(of.row[at], minlength=batch.num_rows)
                    nth = np.arange(len(at)) - (np.cumsum(count) - count)[row]
                    order, row, nth = (x[nth < each] for x in (order, row, nth))
                    at, n, messages, distance = at[order], n[order], messages.take(pa.array(order)), None if distance is None else distance[order]
                    hidden = [pa.array(np.where(nth == 0, np.maximum(count[row] - each, 0), 0), pa.int64())]
                far = pa.array(distance, pa.int64()) if distance is not None else pa.nulls(len(at), pa.int64())
                columns = [batch.column(0).take(pa.array(of.row[at])), pa.array([rule] * len(at), pa.string()), messages, pa.array(of.nth[of.sent[at]]), pa.array(of.at[at]), pa.array(n), far, *hidden]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[x.split()[0] for x in schema.split(", ")]])

    one = f.cut.select("doc_id", *_input(f))
    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, {schema}")


#: What sums() gives of each document beside its counted findings (n_...) and its frequent words.
SUMS = "words long, sentences long, unique long, firsts long, squares long, longest long, syllables long, hard long, letters long, spoken long, content long"


def sums(f: Frames, lists: dict[str, Iterable[str]], kept: list, window: int = 50, min_count: int = 3) -> DataFrame:
    """A row a document: doc_id, the columns `kept` of f.cut, SUMS, n_ columns of counted findings, and often (word, count): its
    words but stopwords that come min_count times, of `content` in all."""
    rules = _rules(lists)
    counted = [*lists, "adverbs", "passive", "echoes", "starters", "monotony", "long_sentence"]
    # the Latin script alone has letters by category; other documents have theirs counted by Spark
    wide = F.when(F.col("prose").rlike(T.ODD), F.aggregate(F.flatten(F.transform("sents", lambda s: s["words"])), F.lit(0).cast("long"), lambda a, w: a + T.letters(T.unmarked(w))))
    one = f.cut.select("doc_id", *_input(f), wide.alias("wide"), *kept)
    extra = [c for c in one.columns if c not in ("doc_id", "words", "sizes", "regions", "wide")]
    schema = [f"{c} {one.schema[c].dataType.simpleString()}" for c in ("doc_id", *extra)] + [SUMS] + [f"n_{c} long" for c in counted] + ["often array<struct<word:string,count:bigint>>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            of = Scan(*batch.columns[1:4])
            rows, by_row = batch.num_rows, lambda at, of=of, rows=batch.num_rows: np.bincount(of.row[at], minlength=rows)
            before = _previous(of.row * max(len(of.kinds), 1) + of.code, of.at)
            first = np.maximum(np.minimum(of.at, of.sizes[of.row] - window) - np.maximum(np.maximum(before + 1, of.at - window + 1), 0) + 1, 0)
            y = _syllables(of.forms)
            hard = (y >= 3) & ~np.asarray(pc.match_substring(of.forms, "-")) & ~_capitalised(of.forms)
            letters = of.total(_letters(of.forms)[of.spelt])
            squares, longest = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            np.add.at(squares, of.of, of.size * of.size)
            np.maximum.at(longest, of.of, of.size)
            other = np.asarray(pc.fill_null(batch.column(4), -1), dtype=np.int64)
            content = ~_one_of(of.kinds, V.STOPWORDS)[of.code]
            key, count = np.unique((of.row * max(len(of.kinds), 1) + of.code)[content], return_counts=True)
            key, count = key[count >= min_count], count[count >= min_count]
            owner = key // max(len(of.kinds), 1)
            often = pa.StructArray.from_arrays([of.kinds.take(pa.array(key % max(len(of.kinds), 1))), pa.array(count.astype(np.int64))], ["word", "count"])
            often = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), often)
            values = [of.sizes, of.sentences, of.total(before < 0), of.total(first), squares, longest, of.total(y[of.spelt]), of.total(hard[of.spelt]), np.where(other >= 0, other, letters), of.total(of.spoken), of.total(content)]
            values += [by_row(rules[r].found(of)[0]) if r in rules else np.zeros(rows, dtype=np.int64) for r in lists]
            values += [by_row(of.adverbs()), by_row(of.passives()[0]), by_row(of.echoes()[0])]
            values += [np.bincount(of.of[x], minlength=rows) for x in (of.opener_runs()[0], of.even_runs()[0], np.flatnonzero(of.size > 40))]
            names = ["doc_id", *extra, *[x.split()[0] for x in SUMS.split(", ")], *[f"n_{c}" for c in counted], "often"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[5:], *[pa.array(v) for v in values], often], names)

    return one.mapInArrow(run, ", ".join(schema))


def tops(f: Frames, words: int, phrases: int, min_length: int = 3) -> DataFrame:
    """(doc_id, kind, item, count): a document's most frequent content words (`word`) and repeated phrases (`repeat`), ties by the
    item, and all its sentence openers (`opener`)."""

    def first(row: np.ndarray, count: np.ndarray, items: pa.Array, most: int) -> np.ndarray:
        """Places of the `most` first ones of each row."""
        place = np.empty(len(row), dtype=np.int64)
        place[np.asarray(pc.sort_indices(items))] = np.arange(len(row))
        order = np.lexsort((place, -count, row))
        begins = np.searchsorted(row[order], row[order])
        return order[np.arange(len(row)) - begins < most]

    def found(of: Scan) -> Iterator[tuple]:
        n = max(len(of.kinds), 1)
        stop = _one_of(of.kinds, V.STOPWORDS)
        content = (np.asarray(pc.greater_equal(pc.utf8_length(of.kinds), min_length)) & ~stop)[of.code]
        key, count = np.unique((of.row * n + of.code)[content], return_counts=True)
        row, items = key // n, of.kinds.take(pa.array(key % n))
        top = first(row, count, items, words)
        yield "word", row[top], items.take(pa.array(top)), count[top]
        at, size, count = repeated(of.code, len(of.kinds), of.row, of.size, stop[of.code])
        items = pa.array([" ".join(of.kinds.take(pa.array(of.code[a : a + k])).to_pylist()) for a, k in zip(at.tolist(), size.tolist(), strict=True)], pa.string())
        top = first(of.row[at], count, items, phrases)
        yield "repeat", of.row[at][top], items.take(pa.array(top)), count[top]
        key, count = np.unique(of.of * n + of.code[of.first], return_counts=True)
        yield "opener", key // n, of.kinds.take(pa.array(key % n)), count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            for kind, row, items, count in found(Scan(*batch.columns[1:])):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([kind] * len(row), pa.string()), items, pa.array(count, pa.int64())], ["doc_id", "kind", "item", "count"])

    one = f.cut.select("doc_id", *_input(f))
    return one.mapInArrow(run, f"doc_id {one.schema['doc_id'].dataType.simpleString()}, kind string, item string, count long")
