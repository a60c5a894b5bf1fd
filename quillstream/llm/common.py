"""Shared pieces of the training-data operators: the shared folder, ordered partitions and word-wise tokenization."""

from __future__ import annotations

import codecs
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_folder

SPACES = b" \t\n\x0b\x0c\r"
#: Texts handed to numpy at once; a longer text is handed over alone.
BATCH_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is an error but in a local session."""
    return checkpoint_folder(spark).rstrip("/")


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Has Hadoop delete an intermediate folder when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstream-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of frames that nothing refers to any more.

    Spark deletes them once the driver's JVM has collected the frames, which one with much memory seldom does by itself; until
    then the files of every earlier step lie on the executors' disks beside those of the present one.
    """
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as an empty one; extra columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_order(docs: DataFrame, guard: bool = False) -> DataFrame:
    """Deals documents to partitions by ascending doc_id and sorts each; `part` numbers the partitions in that order.

    The bounds come from quantiles of the ids alone (a column-pruned read), so a rerun deals alike. Null ids come first,
    ties are ordered by text. With `guard`, the first document of each partition also closes the partition before it and
    the very first one closes the last (`guard` true), so that each row finds its successor in its own partition.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("id"))
    bounds = ids.select(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    steps = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    part_of = lambda c: F.size(F.filter(steps, lambda b: b < c)) if len(bounds) <= 256 else _searched(c, bounds)
    out = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)))).withColumn("part", part_of(F.col("id")))
    if guard:
        firsts = ids.withColumn("part", part_of(F.col("id"))).groupBy("part").agg(F.min("id").alias("first")).orderBy("part").collect()
        before = {r["first"]: firsts[k - 1]["part"] for k, r in enumerate(firsts)}
        rank = spark.createDataFrame([(k, v, min(before) == k) for k, v in before.items()], "id long, before int, wraps boolean") if before else spark.createDataFrame([], "id long, before int, wraps boolean")
        # one row for each partition: its size is bounded by the number of partitions
        out = out.join(F.broadcast(rank), "id", "left")
        out = out.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("guard")))).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("guard")), F.struct(F.col("before").alias("part"), F.when(F.col("wraps"), 2).otherwise(1).alias("guard"))))))
        out = out.drop("part", "before", "wraps").select("*", "at.part", "at.guard").drop("at")
        return out.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guard", "id", F.xxhash64("text"))
    return out.repartitionById(n, F.col("part")).sortWithinPartitions("part", "id", F.xxhash64("text"))


def _searched(c, bounds: list[int]):
    """Binary search in a balanced tree of comparisons, for many partitions."""
    tree = lambda lo, hi: F.lit(lo) if lo == hi else F.when(c > F.lit(bounds[(lo + hi) // 2]), tree((lo + hi) // 2 + 1, hi)).otherwise(tree(lo, (lo + hi) // 2))
    return tree(0, len(bounds))


def chunks(rows: Iterator[tuple], weight) -> Iterator[list[tuple]]:
    """Rows gathered until their weight reaches BATCH_CHARS."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= BATCH_CHARS:
            yield held
            held, total = [], 0
    if held:
        yield held


class WordEncoder:
    """Whole-text encoding with a vocabulary that drops white space (word_bpe_49k.json), with one library call a new word.

    No token of such a vocabulary crosses white space, so a text's ids are those of its words in turn. Words are kept in a
    bounded memo. A word that is Latin-1 letters with ASCII marks after them is encoded as those two pre-tokens, the letters
    in lower case, which most words share with others. `many` does the same for a batch of texts, by Arrow: words, then their
    letters, are told apart for the whole batch, and only letters not kept from earlier batches reach the library.
    """

    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, dtype: str = "<u4", limit: int = 300_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.dtype, self.limit = Tokenizer.from_file(path), dtype, limit
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = ["".join(x for x, _ in level.pre_tokenize_str(chr(c))) for c in range(33, 256) if chr(c).isalpha()]
        spelt = {byte: to for c, x in zip((c for c in range(33, 256) if chr(c).isalpha()), letters, strict=True) for byte, to in zip(chr(c).encode(), x, strict=True)}
        #: How the vocabulary spells each byte of a Latin-1 letter.
        self.spelling = "".join(spelt.get(k, "\ufffe") for k in range(256))
        self.tokenize, size = self.tokenizer.model.tokenize, np.dtype(dtype).itemsize
        self.packed = [k.to_bytes(size, "little") for k in range(self.tokenizer.get_vocab_size())]
        slow, tokenize, packed, join, marks = self.word, self.tokenize, self.packed, b"".join, self.MARKS

        class Memo(dict):
            """Two generations: a full one becomes the old one, from which words still in use come back."""

            old: dict[bytes, bytes] = {}

            def __missing__(self, word: bytes) -> bytes:
                ids = self.old.pop(word, None)
                if ids is None:
                    core = word.rstrip(marks)
                    if not (core.islower() and core.isalpha()):
                        ids = slow(word)
                    elif len(core) == len(word):  # the most frequent case, without a further call
                        ids = join([packed[x.id] for x in tokenize(core.decode())])
                    else:
                        ids = self[core] + self[word[len(core) :]]
                if len(self) >= limit:
                    self.old = dict(self)
                    self.clear()
                self[word] = ids
                return ids

        self.memo = Memo()
        found = "".join(chr(c) for c in range(33, 256) if chr(c).isalpha())
        self.letters, self.lines = found, self.spelling[:10] + "\n" + self.spelling[11:]
        #: What `many` keeps: letters in lower case, their ids one after the other, and how many each has.
        self.known, self.flat, self.counts = pa.array([], pa.string()), np.empty(0, dtype), np.empty(0, np.int64)

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: bytes) -> bytes:
        core = word.rstrip(self.MARKS)
        if core.isalpha():  # ASCII letters, which stand for themselves in the vocabulary
            if len(core) < len(word):
                return self.memo[core] + self.memo[word[len(core) :]]
            if core.islower():
                return b"".join([self.packed[x.id] for x in self.tokenize(core.decode())])
            return self.memo[core.lower()]
        s = core.decode()
        if s.isalpha() and max(s) < "Ā":
            if len(core) < len(word):
                return self.memo[core] + self.memo[word[len(core) :]]
            low = s.lower()
            if low == s:
                return b"".join([self.packed[x.id] for x in self.tokenize(codecs.charmap_decode(core, "strict", self.spelling)[0])])
            return self.memo[low.encode()]
        return self.raw(word.decode())

    def bytes(self, text: str) -> bytes:
        """The text's ids, as bytes of self.dtype."""
        return b"".join(map(self.memo.__getitem__, text.encode().split()))


    def learn(self, cores: pa.Array) -> None:
        """Adds letters in lower case to those that `many` keeps."""
        tokenize, ids, counts = self.tokenize, [], []
        if len(cores):
            for core in codecs.charmap_decode("\n".join(cores.to_pylist()).encode(), "strict", self.lines)[0].split("\n"):
                found = tokenize(core)
                ids += [x.id for x in found]
                counts.append(len(found))
        self.known = pa.concat_arrays([self.known, cores])
        self.flat = np.concatenate([self.flat, np.array(ids, self.dtype)])
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])

    def forget(self, used: pa.Array) -> None:
        """Keeps of the known letters only those in use."""
        keep = pc.is_in(self.known, value_set=used).to_numpy(zero_copy_only=False)
        self.flat, self.known, self.counts = self.flat[np.repeat(keep, self.counts)], self.known.filter(pa.array(keep)), self.counts[keep]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in turn, how many each text has); no text may be null."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        core = pc.ascii_rtrim(words, self.MARKS.decode())
        plain = pc.match_substring_regex(core, f"^[{self.letters}]+$")
        cores, marks = pc.utf8_lower(core.filter(plain)).dictionary_encode(), pc.utf8_ltrim(words.filter(plain), self.letters).dictionary_encode()
        if len(self.known) > 2 * self.limit:
            self.forget(cores.dictionary)
        found = pc.index_in(cores.dictionary, value_set=self.known)
        new, place = pc.is_null(found), found.fill_null(0).to_numpy().copy()
        place[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + found.null_count)
        self.learn(cores.dictionary.filter(new))
        # a word is two runs of ids: its letters and its marks, or itself and nothing
        rest = [self.memo[w.encode()] if w else b"" for w in [*words.filter(pc.invert(plain)).to_pylist(), *marks.dictionary.to_pylist(), ""]]
        is_plain, n = plain.to_numpy(zero_copy_only=False), len(self.known)
        n_other = len(words) - int(is_plain.sum())
        runs = np.full((len(words), 2), n + len(rest) - 1)
        runs[is_plain, 0], runs[~is_plain, 0] = place[cores.indices.to_numpy()], np.arange(n, n + n_other)
        runs[is_plain, 1] = n + n_other + marks.indices.to_numpy()
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(rest), self.dtype)])
        counts = np.concatenate([self.counts, np.array([len(x) for x in rest], np.int64) // flat.itemsize])
        own = _runs(flat, np.cumsum(counts) - counts, counts, runs.reshape(-1))
        counts = counts[runs].sum(1)
        ends = np.concatenate([[0], np.cumsum(counts[at])])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        return _runs(own, np.cumsum(counts) - counts, counts, at), np.diff(ends)


def _runs(flat: np.ndarray, begin: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat that `which` names, one after the other; taken a stretch at a time, since places are larger than ids."""
    out = []
    for k in range(0, len(which), 1 << 18):
        of = which[k : k + (1 << 18)]
        n = counts[of]
        ends = np.cumsum(n)
        out.append(flat[np.repeat(begin[of] - ends + n, n) + np.arange(n.sum())])
    return np.concatenate(out) if out else flat[:0]


def in_chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of an array of texts of about eight times BATCH_CHARS bytes each, a longer text alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * BATCH_CHARS, "right"))
        yield texts.slice(at, max(to, at + 1) - at)
        at = max(to, at + 1)


def windows_of(text: str, most: int = BATCH_CHARS) -> Iterator[str]:
    """Windows of a text, each ending before ASCII white space; one is longer than `most` only where no white space is."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(chr(c), at + 1, at + most) for c in SPACES)
        if end < 0:
            end = min((k for c in SPACES if (k := text.find(chr(c), at + most)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, dtype: str = "<u4") -> WordEncoder:
    """One encoder a Python worker, so that its memo outlives a task."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
