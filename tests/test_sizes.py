"""What showed only on odd texts and larger tables: results beside their SQL, and plans that do a step once."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from quillstream.operators.frames import Frames
from quillstream.operators.lineage import dealt
from quillstream.plans import catalog

ROWS = "doc_id long, text string, lang string, source string"


def beside_sql(spark, folder, names, rows, rename=None) -> None:
    """Compares queries over documents `rows` with their SQL."""
    spark.createDataFrame(rows, ROWS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for name in names:
        df = catalog.queries()[name](spark, str(folder))
        got = sorted(map(tuple, df.collect()), key=repr)
        quoted = ", ".join(f'"{c}"' for c in df.columns)
        assert got == sorted(con.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=repr), name


def test_words_between_quotes_count_in_tense_and_person_queries_as_in_their_sql(spark, tmp_path):
    key = 'token = "0641917ea4e9feb9cda83477b57ac2654884fed"'
    rows = [(1, f"Rain fell on {key} here. He is at home. She was there.", "en", "a"), (2, '"I was there, I called," he said. They are here.', "en", "a")]
    beside_sql(spark, tmp_path, ("tense_sentences", "tense_drift", "pov_counts"), rows)


def test_texts_are_dealt_out_once_and_cut_above_the_exchange(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("One two."), F.sha2(F.col("id").cast("string"), 256), F.lit("Three four.")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for frame in (Frames.plain(docs).sentences, Frames.plain(docs).words):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression") :]
        assert "split" not in below and "regexp" not in below  # no test of the cut text stands below the exchange
        assert plan.count("regexp_extract_all") <= 5  # one cut: a pattern for each kind of sentence
    assert dealt(docs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_ascii_patterns_cut_as_the_wider_ones_do(spark):
    from quillstream.functions import text as T

    pieces = ("It's 3.14, a_b x-y 4-x x-4 a.b. 'Tis", "U.S. e.g. 1,000_a _ __ 9th", "Mr. Ode left. Then 2 came!  (She) said. \"No\"", "a..b a'b' 5'x x:y 1;2 a;b", "x\ty.\nZ", "- -- a--b a-1-b", "")
    texts = [a + " " + b for a in pieces for b in pieces]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    wide = [F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1)) for p in (T.WORD, T.WORD_ASCII)]
    cuts = [F.regexp_replace("t", p, "$1|$2") for p in (T.BOUND, T.BOUND_ASCII)]
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.select(*wide, *cuts).collect())
    bare = df.filter(~F.col("t").rlike("[0-9_]")).select(*[F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1)) for p in (T.WORD_PLAIN, T.WORD_PLAIN_ASCII)]).collect()
    assert bare and all(r[0] == r[1] for r in bare)


def test_a_histogram_makes_its_values_once(spark):
    from quillstream.operators import analyses as A

    values = Frames.plain(spark.createDataFrame([(1, "One two. Three four five. Six.")], "doc_id long, text string")).sentences.select("n_words")
    out = A.histogram(values.withColumnRenamed("n_words", "value"), 1, 5)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_quality_limits_come_from_every_good_document(spark):
    import numpy as np
    import zstandard

    from quillstream.llm import quality_rules as Q

    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(3000)]
    texts = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(60, 300))))) for k in range(8200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    good = {r[0] for r in labels.filter(~Q.held_out(F.col("doc_id"))).select("doc_id").collect()}
    c = zstandard.ZstdCompressor(level=Q.LEVEL)
    data = [t.encode() for k, t in texts if k in good and not Q.base_failed(Q.base_counts(t))]
    assert len(data) > 6000  # what a choice by the hash of ids once stopped at
    size, ratio = np.log2([len(d) for d in data]), np.array([len(c.compress(d)) / len(d) for d in data])
    found, curve = Q.fit(docs, labels), np.polyfit(size, ratio, 2)
    assert np.allclose(np.polyval(found.curve, size), np.polyval(curve, size), atol=1e-6)
    off = ratio - np.polyval(curve, size)
    for knot, below in zip(found.knots, found.below, strict=True):
        near = off[np.abs(size - knot) <= 0.75]
        assert len(near) >= Q.SUPPORT and abs(np.quantile(near, Q.BELOW, method="lower") - below) < 3e-5


def test_ends_of_documents_look_at_each_word_once(spark):
    from quillstream.operators.corpus import _ends

    rows = _ends(Frames.plain(spark.createDataFrame([(1, "a b a c. B d"), (2, "")], "doc_id long, text string")), 3)
    assert "array_position" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[2:] for r in rows.collect()] == [(6, 11, [0, 1], ["a", "b"], ["a", "c", "b", "d"])]


def test_counts_leave_out_documents_without_words_or_an_id_as_their_sql(spark, tmp_path):
    rows = [(1, "One two. Three!", "en", "a"), (2, "123 456 ...", "en", "a"), (3, None, "en", "a"), (4, "", "de", "a"), (5, " ?! \n ", "en", "a"), (None, "Here are four words.", "en", "a"), (6, "Ein Satz.", "de", "a")]
    beside_sql(spark, tmp_path, ("counts_by_doc", "counts_total"), rows)
