"""The training-data operators against brute force, on a table with nulls, empties, repeats, a long text and extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm import byte_cnn, edit_embedding, labelled, mixing, packing, quality_rules, simhash, token_counts, token_output, toxicity, url_filter
from quillstream.llm.common import WordEncoder, in_chunks, windows_of, word_bpe
from quillstream.llm.range_coder import decode_blocks, encode_blocks

RNG = np.random.default_rng(1)
VOCAB = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
LONG = " ".join(RNG.choice(VOCAB, 9000))
BASE = " ".join(RNG.choice(VOCAB, 120))
ROWS = [(1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace(" ", "  ", 3), None), (4, None, "b"), (5, "", "b"), (6, LONG, "a"), (7, "Ünïcode! Don't <|endoftext|> x", "c"), (7, "repeated id", "c"), (None, "no id", "a"), (9, " ".join(BASE.split()[:-1]) + " changed", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n", F.lit(1)).withColumn("fp", F.lit("clash")).withColumn("part", F.lit(3))


def ids_of(text, end):
    t = Tokenizer.from_file(word_bpe())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_encoder():
    coder = WordEncoder(word_bpe())
    for text in ["Don't stop, İstanbul's naïve ﬁ é́ \x1c ª12!!", "", " \t\n", LONG[:500], "a<|endoftext|>b 'S 日本語 ³"]:
        assert coder.bytes(text) == coder.raw(text)


def test_batches_of_texts():
    """Ids of a batch are those of each text; a word is given to the library once, and what is kept stays bounded."""
    texts = ["Don't stop, İstanbul's naïve ﬁ é́ \x1c ª12!! µm MÜNCHEN... ÿ Ÿ ẞ", "", " \t\n", LONG[:500], "a<|endoftext|>b 'S 日本語 ³ ###", " lead Straße-n, Straße!! trail ", "x \xa0y z\x0b\x0cw\x00v", ""] * 2
    for dtype in ("<u2", "<u4"):
        coder = WordEncoder(word_bpe(), dtype, limit=20)
        expected = [coder.raw(t) for t in texts]
        for column, held in ((pa.array(texts), expected), (pa.array(texts).slice(3, 7), expected[3:10]), (pa.array(["Ab ab"]), [coder.raw("Ab ab")])):
            ids, sizes = coder.many(column)
            assert ids.tobytes() == b"".join(held) and (sizes * ids.itemsize).tolist() == [len(x) for x in held]
        assert coder.known.to_pylist() == ["ab"]  # over the limit, only what the batch uses is kept
        assert not len(coder.many(pa.array([], pa.string()))[0])
    coder, asked = WordEncoder(word_bpe()), []
    coder.tokenize = lambda w, f=coder.tokenize: asked.append(w) or f(w)
    for _ in range(2):
        coder.many(pa.array(["Apple pear apple, PEAR!", "pear. apple"]))
    assert sorted(asked) == ["apple", "pear"]
    long = pa.array(["a" * 10, "b" * 40_000_000, "c", "d" * 31_999_999, "e"])
    assert [x.to_pylist() for x in in_chunks(long)] == [["a" * 10], ["b" * 40_000_000], ["c", "d" * 31_999_999], ["e"]]


def test_blocks_of_one_length_learn_alike():
    """Many segments of full blocks, whose reader fills the same arrays segment after segment; the bytes are as they were."""
    rng = np.random.default_rng(11)
    blocks = [rng.choice(700, 2048, p=(w := 1 / np.arange(1, 701)) / w.sum()).astype(np.uint16) for _ in range(600)]
    coded, prior = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(coded, [2048] * 600, prior), strict=True))
    assert (zlib.crc32(b"".join(coded)), zlib.crc32(prior)) == (3214720408, 2521372648)


def test_range_coder_round_trip():
    blocks = [RNG.integers(0, top, n).astype(np.uint16) for top, n in ((3, 700), (49408, 65), (65536, 1), (2, 0), (400, 300), (65536, 5000))]
    coded, prior = encode_blocks(blocks)
    for a, b in zip(blocks, decode_blocks(coded, [len(b) for b in blocks], prior), strict=True):
        assert (a == b).all() and len(a) == len(b)
    for k, a in enumerate(blocks):  # each decodes alone
        assert (decode_blocks([coded[k]], [len(a)], prior)[0] == a).all()
    assert encode_blocks([]) == ([], b"")
    skewed = [RNG.choice(5000, 2048, p=(w := 1 / np.arange(1, 5001)) / w.sum()).astype(np.uint16) for _ in range(8)]
    coded, prior = encode_blocks(skewed)
    p = np.bincount(np.concatenate(skewed)) / (8 * 2048)
    assert sum(map(len, coded)) < 1.06 * 2048 * -(p[p > 0] * np.log2(p[p > 0])).sum()
    with pytest.raises(ValueError, match="below"):
        encode_blocks([np.array([70_000], np.int64)])


def test_damage_shows(spark, docs, tmp_path):
    files = token_output.encode(docs)
    for column, value in (("payload", F.overlay("payload", F.lit(b"\x05\x05"), F.lit(3))), ("pieces", F.transform("pieces", lambda p: p.withField("doc_id", p["doc_id"] + 1)))):
        path = str(tmp_path / column)
        files.withColumn(column, value).write.parquet(path)
        with pytest.raises(Exception, match="damaged"):
            token_output.read_digests(spark, path).collect()


def test_token_output(spark, docs, tmp_path):
    token_output.write(docs, str(tmp_path / "ids"))
    found = token_output.read_digests(spark, str(tmp_path / "ids")).orderBy("start").collect()
    expected, start = [], 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text, 1)
        expected.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(str, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in found])) == sorted(map(str, expected))
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert token_output.encode(docs.limit(0)).count() == 0


def test_packing(docs):
    pieces = packing.pack(docs.filter("doc_id <> 7")).toPandas()
    for doc_id, text, _ in ROWS:
        if doc_id not in (7, None):
            ids, own = ids_of(text, 2), pieces[pieces.doc_id == doc_id].sort_values("start")
            assert own.length.sum() == len(ids)
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    sizes = pieces.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sizes)
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_simhash_components(docs):
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    fps = {r[0]: int(simhash.majority_bits(simhash.shingle_hashes(r[1] or "", 4))) for r in ROWS if r[0] not in (7, None)}
    for i, fp in fps.items():
        near, grown = {i}, True
        while grown:
            more = near | {k for k in fps for m in near if (fps[k] ^ fps[m]).bit_count() <= 4}
            grown, near = more != near, more
        assert (i, f"{fp:016x}", min(near)) in found
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_forest_is_exact():
    fps = RNG.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    fps[1000:2000] = fps[:1000] ^ np.uint64(0b1001000000010000000000001)
    forest = simhash.Forest(fps[:2000], simhash.disjoint_groups(3), 5, 1)
    found = set()
    for g in range(3):
        row, leaf, home = forest.leaves(g, fps)
        for k in np.unique(leaf):
            own = row[leaf == k]
            found |= {frozenset((int(own[a]), int(own[b]))) for a, b in simhash.spanning_links(fps[own], home[leaf == k], 4)}
    brute = {frozenset((a, b)) for a in range(3000) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 4).tolist() if a < b}
    assert brute <= found and all(len(p) == 2 for p in found)


def test_keep_representatives(docs):
    kept = sorted(str(r.doc_id) for r in simhash.keep_representatives(docs).collect())
    assert "1" in kept and "2" not in kept and "9" not in kept and "6" in kept and "None" in kept
    assert kept.count("7") == 2  # different texts of one id, in different groups
    again = docs.unionByName(docs.withColumn("source", F.lit("z")))  # each row twice, but for one column
    assert sorted(str(r.doc_id) for r in simhash.keep_representatives(again).collect()) == sorted([*kept, "None"])
    assert simhash.keep_representatives(docs.limit(0)).count() == 0


def test_rows_without_id_link_others(spark):
    """Two texts 8 bits apart, linked by a row without doc_id that is 4 bits from each."""
    words = [f"t{k}" for k in range(400)]
    fps = {}
    for k in range(400):
        text = " ".join(words[:30] + words[k : k + 8])
        fps.setdefault(int(simhash.majority_bits(simhash.shingle_hashes(text, 4))), text)
    near = lambda a, b: (a ^ b).bit_count() <= 4
    a, m, b = next((a, m, b) for m in fps for a in fps if near(a, m) for b in fps if near(m, b) and not near(a, b))
    rows = [(5, fps[a]), (None, fps[m]), (3, fps[b])]
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {5: 3, None: 3, 3: 3}


def test_near_duplicates_by_exact_likeness(spark, monkeypatch):
    """Groups against brute force, with many leaves and blocks: pairs on both sides of 0.8, short texts, a repeated line."""
    monkeypatch.setattr(simhash, "LEAF", 32)
    monkeypatch.setattr(simhash, "EXACT_ROWS", 8)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(120):
        words = rng.choice(VOCAB, int(rng.choice([12, 40, 150, 400]))).tolist()
        texts.append(" ".join(words))
        for _ in range(int(rng.integers(1, 4))):
            edited = list(words)
            for at in rng.choice(len(words), max(1, round(len(words) * rng.uniform(0.005, 0.05))), replace=False):
                edited[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(edited))
    line = " ".join(rng.choice(VOCAB, 100))
    texts += [line, line + (" " + " ".join(line.split()[:9])) * 60]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert jaccard(sets[-1], sets[-2]) >= 0.8
    label, pairs = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            if (x := jaccard(sets[i], sets[j])) > 0.5:
                pairs.append((i, j, x))
                if x >= 0.8 and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if c == high else c for c in label]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(0.8 <= x < 0.85 for *_, x in pairs) >= 10 and sum(0.7 <= x < 0.8 for *_, x in pairs) >= 20
    assert not [p for p in pairs if label[p[0]] != label[p[1]] and found[p[0]] == found[p[1]]]  # no false merge
    assert sum(found[i] == found[j] for i, j, x in pairs if x >= 0.8) >= 0.99 * sum(x >= 0.8 for *_, x in pairs)
    assert found[len(texts) - 1] == len(texts) - 2


def brute_kept(text: str, compressor, limits=None) -> bool:
    """The verdict of the quality rules, from their words: base counts, then the bands of whole texts and of each chunk."""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)})
    data = text.encode()
    if len(words) < 50 or 100 * repeated > 50 * len(words):
        return False

    def inside(part: bytes, slack: float) -> bool:
        low, high = [b[1:] for b in quality_rules.DOCUMENT_BANDS if len(part) >= b[0]][-1]
        x = float(np.log2(len(part)))
        if limits and limits.knots[0] - 0.25 <= x <= limits.knots[-1] + 0.25:
            k = min(max(sum(knot <= x for knot in limits.knots) - 1, 0), len(limits.knots) - 2)
            (x0, x1), (y0, y1) = limits.knots[k : k + 2], limits.below[k : k + 2]
            below = y0 + (y1 - y0) * min(max((x - x0) / (x1 - x0), 0), 1)
            a, b, c = limits.curve
            low = max(low, a * x * x + b * x + c + below)
        return low - slack <= len(compressor.compress(part)) / len(part) <= high

    chunks = [data[i * 2048 :] if i + 1 == len(data) // 2048 else data[i * 2048 : (i + 1) * 2048] for i in range(len(data) // 2048)]
    assert not chunks or b"".join(chunks) == data
    bad = sum(not inside(x, 0.01) for x in chunks) if len(chunks) > 1 else 0
    return inside(data, 0) and bad <= 0.34 * max(len(chunks), 1)


def test_quality_rules_against_brute_force(spark):
    import zstandard

    c = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(VOCAB[: int(rng.choice([3, 20, 300]))], int(rng.integers(0, 1500)))) for _ in range(60)]
    texts += ["".join(chr(int(x)) for x in rng.integers(33, 1000, 9000)), "x\ty\x0bz\u00a0w " * 40, ("é" * 30 + " ") * 80]
    half = " ".join(rng.choice(VOCAB, 1200))
    texts += [half + " " + " ".join(f"{w}{i % 7}" for i, w in enumerate(VOCAB[:40] * 30))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    limits = quality_rules.Limits((0.002, -0.06, 0.95), (8.0, 9.5, 11.0, 13.0), (-0.01, -0.03, -0.02, -0.01))
    for some in (quality_rules.Limits(), limits):
        found = quality_rules.quality_rules(table, some).collect()
        assert {r.doc_id: r.kept for r in found} == {i: brute_kept(t, c, some if some.knots else None) for i, t in enumerate(texts)}
        assert len({r.kept for r in found}) == 2


def test_bands_are_learnt_and_decide(spark):
    """Good texts of all lengths stay, those of the same words with marks that repeat go, though no base rule fails."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(900):
        n = int(rng.integers(60, 1500))
        words = [f"{a}{b}" for a, b in zip(rng.choice(VOCAB, n), rng.choice(VOCAB, n), strict=True)]
        good = i % 10 > 0
        rows.append((i, " ".join(words if good else [f"{w}&&&***" for w in words])))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, quality int")
    found = quality_rules.quality_rules(docs, quality_rules.fit(docs, known)).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert not any(r.base_failed for r in found)
    assert np.mean([not r.kept for r in held if r.doc_id % 10 == 0]) > 0.9
    assert np.mean([r.kept for r in held if r.doc_id % 10]) > 0.95
    assert quality_rules.fit(docs, known.limit(0)) == quality_rules.fit(docs.limit(0), known) == quality_rules.Limits()


def test_quality_rules(docs):
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert found[1].kept and not found[4].kept and not found[5].kept and found[6].kept
    n, chars, symbols, dup, rep = quality_rules.base_counts("a b c a b c\nx #\nx #\n\n")
    assert (n, chars, symbols, dup) == (10, 10, 2, 1)
    words = "a b c a b c x # x #".split()
    windows = [tuple(words[i : i + 3]) for i in range(8)]
    assert rep == len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})
    repetitive = docs.limit(1).withColumn("text", F.lit(" ".join(f"{x} {x} {x}{i % 9}" for i, x in enumerate(VOCAB[:9] * 200))))
    assert quality_rules.keep_good(repetitive).count() == 0
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_mixing(docs):
    big = docs.sparkSession.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise("rest").alias("source"), F.lit("t").alias("text"))
    weights = big.sparkSession.createDataFrame([("hot", 1.0), (None, 1.0), ("gone", 5.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mix_sources(big, weights, repetition=1.0).groupBy("source").count().collect()}
    total = 10_000  # weights of sources that the table lacks take no share
    assert set(n) == {"hot", None} and all(abs(c - total) < 6 * total**0.5 for c in n.values())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    taken = docs.withColumn("copy", F.lit("mine"))
    with pytest.raises(ValueError, match="copy"):
        mixing.mix_sources(taken)
    assert {r.copy for r in mixing.mix_sources(taken, copy="nth").select("copy").collect()} <= {"mine"}


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.NET/en/1"), (2, "https://x.example.net/de/"), (3, "http://q.example.com/de/x?y"), (4, None), (5, "nothing"), (6, "http://fr.org/fr/?://net/"), (7, "http://a.net")], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert found[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and found[2][2:] == ("net/", "block")
    assert found[3][2:] == ("example.com/de/", "block") and found[4][:3] == ("", "", None) and found[5][:2] == ("", "")
    assert found[6] == ("fr.org", "/fr/", "org/fr/", "allow") and found[7][:3] == ("a.net", "", None)


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "page_id long, bad int")
    verdicts = {(r.template, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert verdicts == {("h.org/spam/*", "block"), ("h.org/news/*", "allow")}


def test_url_templates_small_and_deep_sections(spark):
    """A bad section of 1.5 % of a large host, and one below the fourth segment, stay apart."""
    wide = [(i, f"http://h.org/{'spam' if i % 67 == 0 else 'news'}/{i}") for i in range(8000)]
    deep = [(i, f"http://d.org/a/b/c/d/{'spam' if i % 2 else 'news'}/{i}") for i in range(8000, 9000)]
    pages = spark.createDataFrame(wide + deep, "page_id long, url string")
    labels = spark.createDataFrame([(i, int("spam" in u)) for i, u in wide + deep], "page_id long, bad int")
    assert url_filter.judge(pages, labels).filter((F.col("verdict") == "block") != F.col("path").contains("spam")).count() == 0


def brute_templates(rows, support, z):
    """(template, purity) of each (host, segments, bad), the tree grown recursively in plain Python."""

    def differ(b1, m1, b2, m2):
        rate = (b1 + b2 + 0.5) / (m1 + m2 + 1)
        return abs(b1 / m1 - b2 / m2) > z * (rate * (1 - rate) * (1 / m1 + 1 / m2)) ** 0.5

    out = {}

    def grow(members, name, depth, deepest):
        here = {}
        for k in members:
            if len(rows[k][1]) <= depth:
                out[k] = name
            elif depth == deepest:
                out[k] = name + "/**"
            else:
                here.setdefault(rows[k][1][depth], []).append(k)
        stats = {s: ([rows[k][2] for k in ks if rows[k][2] is not None], len(ks)) for s, ks in here.items()}
        all_b, all_m = sum(sum(x) for x, _ in stats.values()), sum(len(x) for x, _ in stats.values())
        kept = [s for s, (x, n) in stats.items() if n >= support and x and all_m > len(x) and differ(sum(x), len(x), all_b - sum(x), all_m - len(x))]
        kept.sort(key=lambda s: (sum(stats[s][0]) / len(stats[s][0]), s))
        runs = []
        for s in kept:
            last = stats[runs[-1][-1]][0] if runs else None
            if last is None or differ(sum(stats[s][0]), len(stats[s][0]), sum(last), len(last)):
                runs.append([])
            runs[-1].append(s)
        for run in runs:
            label = run[0] if len(run) == 1 else "{" + min(run) + f",+{len(run) - 1}}}"
            grow([k for s in run for k in here.pop(s)], f"{name}/{label}", depth + 1, deepest)
        if here:
            grow([k for ks in here.values() for k in ks], f"{name}/*", depth + 1, deepest)

    deepest = 0
    while sum(len(r[1]) > deepest for r in rows) >= support:
        deepest += 1
    for host in {r[0] for r in rows}:
        grow([k for k, r in enumerate(rows) if r[0] == host], host, 0, deepest)
    return [out[k] for k in range(len(rows))]


def test_url_tree_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        host = f"h{rng.integers(3)}.org"
        segments = [["a", "b", "c", "d", "e"][rng.integers(5)], ["x", "y", "z"][rng.integers(3)], f"p{rng.integers(400)}", "deep"][: rng.integers(0, 5)]
        rate = {"a": 0.9, "b": 0.85, "c": 0.5, "d": 0.1, "e": 0.15}.get(segments[0] if segments else "c") * (0.3 if segments[1:2] == ["z"] else 1)
        rows.append((host, segments, int(rng.random() < rate) if rng.random() < 0.6 else None))
    pages = spark.createDataFrame([(k, f"http://{h}/" + "/".join(s)) for k, (h, s, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (*_, b) in enumerate(rows) if b is not None], "page_id long, bad int")
    found = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    expected = brute_templates(rows, url_filter.SUPPORT, url_filter.Z)
    assert [found[k].template for k in range(len(rows))] == expected
    assert any("{" in t for t in expected) and len(set(expected)) > 3 * len({r[0] for r in rows})
    # purities: shares of bad labels shrunk to the host's, the weight from the spread of templates
    total = [b for *_, b in rows if b is not None]
    overall = (sum(total) + 1) / (len(total) + 2)
    of = {t: [b for (*_, b), x in zip(rows, expected, strict=True) if x == t and b is not None] for t in set(expected)}
    host_of = {t: t.split("/")[0] for t in of}
    host = {h: (sum(sum(x) for t, x in of.items() if host_of[t] == h) + 8 * overall) / (sum(len(x) for t, x in of.items() if host_of[t] == h) + 8) for h in set(host_of.values())}
    seen = one = two = 0.0
    for t, x in of.items():
        if len(x) > 1:
            r, m = host[host_of[t]], len(x)
            seen, one, two = seen + (sum(x) - m * r) ** 2, one + m * r * (1 - r), two + m * (m - 1) * r * (1 - r)
    smooth = min(max(two / (seen - one) - 1, 1), 1000)
    for k, t in enumerate(expected):
        purity = (sum(of[t]) + smooth * host[host_of[t]]) / (len(of[t]) + smooth)
        assert abs(found[k].purity - purity) < 1e-5
        assert found[k].rule is not None or found[k].verdict == ("block" if purity > 0.5 else "allow")
    assert {r.verdict for r in found.values()} == {"allow", "block"}
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_classifiers(spark):
    """Also a toxic text with one rare expression alone is found; a long text is judged in windows; repeated rows are alike."""
    good = [" ".join(RNG.choice(VOCAB, 40)) for _ in range(600)]
    rude = {1: " wretched", 4: " wretched wretched fool"}
    rows = [(i, t.upper() + " ###" if i % 3 == 0 else t + rude.get(i % 6, "")) for i, t in enumerate(good)]
    docs = spark.createDataFrame([*rows, (1000, None), (1, rows[1][1]), (1001, " ".join(good[:60] * 4) + " wretched")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 1)) for i, _ in rows], "doc_id long, quality int, toxic int")
    for module, column in ((byte_cnn, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels)
        out = module.score(docs, model).cache()
        assert out.count() == 603 and out.filter("score < 0 or score > 1").count() == 0
        held = out.join(labels, "doc_id").filter("held_out")
        assert held.filter(F.col("predicted") == F.col(column)).count() >= 0.9 * held.count()
        assert len({r.score for r in out.filter("doc_id = 1").collect()}) == 1
        if module is toxicity:
            single = held.filter("doc_id % 6 = 1")
            assert single.filter("predicted = 1").count() >= 0.9 * single.count()
        assert module.score(docs.limit(0), module.fit(docs, labels.limit(0))).count() == 0


def test_long_texts_score_alike_in_segments(monkeypatch):
    weights = byte_cnn.train([(i % 2, " ".join(RNG.choice(VOCAB[: 10 + 200 * (i % 2)], 30))) for i in range(60)])
    step = byte_cnn.HALF * byte_cnn.STRIDE
    texts = [bytes(RNG.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 3, 4, 5, 8, step - 1, step, step + 1, 2 * step, 2 * step + 4, 3 * step + 5, 5 * step, 40 * step + 7)]
    whole = np.array([byte_cnn.probabilities(weights, [t])[0] for t in texts])
    plain = [byte_cnn._blocks([byte_cnn._padded(t)]) for t in texts]
    for t, (blocks, windows), p in zip(texts, plain, whole, strict=True):
        top, halves, _ = byte_cnn._pooled(weights, blocks, windows)
        f = byte_cnn._features(top, halves, weights["bias"])[0]
        assert abs(p - 1 / (1 + np.exp(-(f @ weights["out"][:-1] + weights["out"][-1])))[0]) < 1e-5
    for size in (step, 2 * step, 8 * step):
        monkeypatch.setattr(byte_cnn, "SEGMENT", size)
        assert np.abs(byte_cnn.probabilities(weights, texts) - whole).max() < 1e-5


def test_sample_takes_windows_of_long_texts(spark):
    text = "".join(chr(97 + k % 26) for k in range(1000))
    docs = spark.createDataFrame([(i, text if i % 2 else "short", None if i == 7 else "s") for i in range(40)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", {0: 5, 1: 5}, 400)
    assert [y for y, _ in rows].count(1) == 5 and len(rows) == 10  # ids without a document leave no gap
    assert {t for y, t in rows if y} == {" ".join(text[k * 300 : k * 300 + 100] for k in range(4))}


def test_toxicity_tables_and_windows():
    keys = RNG.integers(0, 2**63, 5000).astype(np.uint64)
    table = toxicity.Table(keys, np.arange(5000))
    value, found = table.get(keys)
    assert found.all() and (value == np.arange(5000)).mean() > 0.999
    assert table.get(RNG.integers(0, 2**63, 20000).astype(np.uint64))[1].mean() < 0.001
    text = " ".join(RNG.choice(VOCAB, 5000))
    for most in (10, 1000, 10**6):
        parts = list(windows_of(text, most))
        assert "".join(parts) == text and all(len(p) <= max(most, 8) for p in parts)
    assert list(windows_of("x" * 50, 10)) == ["x" * 50] and list(windows_of("", 10)) == [""]


def test_edit_fingerprints(docs):
    some = docs.filter("doc_id <> 7")
    found = {r.doc_id: r for r in edit_embedding.fingerprint_edits(some).collect()}
    assert found[1].near_next == 1.0 and found[1].fingerprint == found[2].fingerprint and found[6].n_chars == len(LONG)
    assert 0.3 < found[6].near_edited < 0.8
    groups = {r.doc_id: r.component_id for r in edit_embedding.edit_duplicates(some).collect()}
    assert groups[1] == groups[2] == groups[9] == 1 and groups[6] == 6
    assert edit_embedding.fingerprint_edits(docs.limit(0)).count() == 0


def test_edited_texts_are_recomputed(spark):
    """Lengths, hashes and likenesses against texts edited here, whose walks begin anew; the last one meets the first."""
    texts = [t for _, t, _ in ROWS if t is not None] + ["", "é\U0001f40b" * 40]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    e = edit_embedding.Embedding()
    of = lambda t: e.sample(c := edit_embedding.codes_of(t), e.walk(c))
    found = {r.doc_id: r for r in edit_embedding.fingerprint_edits(docs).collect()}
    for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True)):
        half = len(a) // 2
        edited, r = a[: len(a) - half] + b[:half], found[3 * i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (of(a).tobytes().hex(), of(edited).tobytes().hex())
        assert (r.near_edited, r.near_next) == (edit_embedding.likeness(of(a), of(edited)), edit_embedding.likeness(of(a), of(b)))


def test_edits_link_through_rows_without_an_id(spark):
    words = " ".join(RNG.choice(VOCAB, 400)).split()
    chain = [" ".join([*words[: 400 - 12 * k], *("new" + w for w in words[400 - 12 * k :])]) for k in range(4)]
    rows = [(5, chain[0]), (None, chain[1]), (None, chain[2]), (9, chain[3]), (None, "alone " * 50), (5, "another text of the same id " * 9), (None, None), (20, "")]
    found = edit_embedding.edit_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("least", F.lit(1)), 0.7).collect()
    assert len(found) == len(rows)
    assert sorted(str(r.component_id) for r in found if r.doc_id is None) == ["20", "5", "5", "None"]
    assert [r.component_id for r in found if r.doc_id == 9] == [5] and [r.component_id for r in found if r.doc_id == 20] == [20]


def test_token_counts(docs):
    found = token_counts.token_counts(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in found}[6] == len(ids_of(LONG, 1)) - 1 and {r.doc_id: r.n for r in found}[4] == 0
    assert token_counts.owners(np.array([0, 3, 4]), np.array([3, 7, 8]), np.array([0, 5, 6, 10])).tolist() == [0, 0, 2]
    assert token_counts.owners(np.array([4]), np.array([6]), np.array([0, 5, 10])).tolist() == [0]


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on a small table with clashing columns, nulls, repeats: each compared with its operator's rule in plain Python."""
    import corpus_pipeline
    from quillstream.llm.labelled import sample

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(VOCAB, int(rng.integers(20, 160)))) for _ in range(150)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + [None, "", "a b c " * 60]
    rows = [(i, t, "en", "hot" if i % 3 else None, len(t or ""), "mine") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 180, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(stages) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs.collect()
    import zstandard

    c = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    limits = quality_rules.fit(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {i for i, t in enumerate(texts) if brute_kept(t or "", c, limits if limits.knots else None)}
    assert {r.doc_id for r in held["quality_rules"]} == good and {r.copy for r in held["quality_rules"]} == {"mine"}
    weights = byte_cnn.train(sample(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")), "quality", byte_cnn.PER_CLASS, byte_cnn.MAX_CHARS))
    passing = {i for i in good if byte_cnn.probabilities(weights, [(texts[i] or "").encode()])[0] >= byte_cnn.THRESHOLD}
    assert {r.doc_id for r in held["quality_classifier"]} == passing
    sets, label = {i: set(simhash.shingle_hashes(texts[i], 5).tolist()) for i in passing}, {i: i for i in passing}
    for i in sorted(passing):
        for j in sorted(passing):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert sorted(r.doc_id for r in held["near_duplicates"]) == sorted(set(label.values()))
    drawn = {r.doc_id: sum(x.doc_id == r.doc_id for x in held["source_mix"]) for r in held["near_duplicates"]}
    count = {s: sum(r.source == s for r in held["near_duplicates"]) for s in ("hot", None)}
    total = sum(count.values())
    for r in held["near_duplicates"]:
        mean = total * count[r.source] ** 0.5 / sum(n**0.5 for n in count.values()) / count[r.source]
        assert mean <= mixing.CHUNK_MEAN
        u = int(hashlib.md5(f"7:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total_p = 0, np.exp(-mean), np.exp(-mean)
        while total_p <= u:
            n += 1
            p *= mean / n
            total_p += p
        assert drawn[r.doc_id] == n
    pieces: dict = {}
    for r in held["packing"]:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, n in drawn.items():
        ids = ids_of(texts[i], 2)
        assert sum(length for _, length, _ in pieces.get(i, [])) == n * len(ids)
        assert all(zlib.crc32(ids[a : a + m].tobytes()) == crc for a, m, crc in pieces.get(i, []))
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
