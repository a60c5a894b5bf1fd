"""Places of findings, chart points, pages and the stream, on small texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import analyses as A
from quillstream.operators import charts as C
from quillstream.operators import listing as G
from quillstream.operators import located as L
from quillstream.operators import corpus as W
from quillstream.operators import render as P
from quillstream.operators import report as R
from quillstream.operators.frames import Frames
from quillstream.streaming.reanalysis import reanalyse

TEXT = "\U0001f40b \U0001f40b Dr. Weiss spoke softly.\n  He was quickly forgotten by all.\n\nSort of dark, it seemed. Lantern light; a lantern-lit, lantern hall."


def frames(spark, *texts):
    return Frames.plain(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_places_cut_the_words(spark):
    f = frames(spark, TEXT, "", "one")
    words = {(r.doc_id, r.pos): r.raw for r in f.words.collect()}
    lines = TEXT.split("\n")
    rows = L.word_places(f).collect()
    assert {(r.doc_id, r.pos) for r in rows} == set(words)
    for r in rows:
        source, line = (TEXT, lines[r.line - 1]) if r.doc_id == 0 else ("one", "one")
        assert source[r.start : r.start + r.length] == words[r.doc_id, r.pos] == line[r.column - 1 : r.column - 1 + r.length]
        assert line.encode("utf-16-le")[2 * r.unit : 2 * (r.unit + r.units)].decode("utf-16-le") == words[r.doc_id, r.pos]


def test_places_in_marked_up_texts(spark):
    """Whatever is masked before them, with characters of one to four bytes, words stand where the source has them."""
    odd = "é日\U0001f40b"
    markdown = [f"---\ntitle: {odd}\n---", f"# Head {odd}", f"Setext {odd}\n===", f"One `{odd}` two **{odd}three** ~~four~~.", f"![{odd}](a{odd}) five [link {odd} six](t{odd}) [^{odd}] seven.",
                f"> - [x] {odd} eight\n> 9. nine", f"<b class='{odd}'>ten</b> https://x.y/{odd} eleven \\* twelve _thirteen_", f"Before <!-- {odd} --> after <!-- {odd}", f"{odd} --> end", f"~~~{odd}\n{odd} code\n~~~", f"| {odd} | table |", f"{odd}\n\nlast word\x1f here"]
    fountain = [f"Title: {odd}\nAuthor: x", f"# Act {odd}", f"INT. HOUSE {odd} - DAY", f"He *{odd} waits* [[note {odd}]] here.", f"MARA {odd}\n({odd} softly)\nThe *{odd}* night /* {odd}\n{odd} */ is cold.", f"> {odd} CUT TO:", f"!{odd} forced _action_", f"= synopsis {odd}", f"> centred {odd} <"]
    texts = {1: ("markdown", "\n\n".join(markdown)), 2: ("fountain", "\n\n".join(fountain))}
    f = Frames.marked_up(spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id long, format string, source string")).settled()
    words = {(r.doc_id, r.pos): r.raw for r in f.words.collect()}
    rows = L.word_places(f).collect()
    assert {(r.doc_id, r.pos) for r in rows} == set(words) and len([k for k in words if k[0] == 1]) >= 15 and len([k for k in words if k[0] == 2]) >= 8
    for r in rows:
        line = texts[r.doc_id][1].split("\n")[r.line - 1]
        assert line[r.column - 1 : r.column - 1 + r.length] == words[r.doc_id, r.pos] == texts[r.doc_id][1][r.start : r.start + r.length]
        assert line.encode("utf-16-le")[2 * r.unit : 2 * (r.unit + r.units)].decode("utf-16-le") == words[r.doc_id, r.pos]


def test_located_and_diagnostics(spark):
    f = frames(spark, TEXT)
    found = {(r.rule, r.message): r for r in L.located(f, hedges=["sort of", "seemed"], filters=[], cliches=[]).collect()}
    cut = lambda r: TEXT.split("\n")[r.line - 1][r.column - 1 : r.end_column - 1]
    assert cut(found["adverbs", "softly"]) == "softly"
    assert cut(found["passive", "was quickly forgotten by"]) == "was quickly forgotten by"
    assert cut(found["hedges", "sort of"]) == "Sort of" and found["hedges", "sort of"].line == 4
    assert cut(found["hedges", "seemed"]) == "seemed"
    assert found["adverbs", "softly"].text.endswith("Dr. Weiss spoke softly.")
    softly = next(r for r in L.diagnostics(f, filters=[], cliches=[]).collect() if r.message == "softly")
    assert (softly.line, softly.character, softly.end_character, softly.severity, softly.code) == (0, 22, 28, 3, "adverbs")
    assert [r.message for r in L.visible(L.located(f, hedges=["sort of"], filters=[], cliches=[]), 4, 4, ["hedges"]).collect()] == ["sort of"]


def test_points_and_lines(spark):
    f = frames(spark, "One two. One two three four. One.\n\nOne two three.")
    rows = C.sentence_series(f, A.adverbs(f.words)).orderBy("sent").collect()
    assert [(r.words, r.first_word, r.paragraph_words, r.variation) for r in rows] == [(2, 1, 7, 0.0), (4, 3, 7, 33.3333), (1, 7, 7, 53.4522), (3, 8, 3, 44.7214)]
    points = C.points(C.sentence_series(f, A.adverbs(f.words)), 3).orderBy("point").collect()
    assert [(p.first_sentence, p.last_sentence, p.words, p.sentence_length, p.paragraph_length) for p in points] == [(0, 1, 6, 3.0, 7.0), (2, 2, 1, 1.0, 7.0), (3, 3, 3, 3.0, 3.0)]
    assert C.sparkline(f.sentences, "n_words", "sent").first().line == "▃█▁▆"


def test_page_and_slug(spark):
    f = frames(spark, "He spoke <softly> & quickly left.", "")
    metrics = R.metrics(f)
    review = L.placed(f, R.revisions_by_document(f, each=1, limit=1))
    trend = f.docs.sparkSession.createDataFrame([(0, 1, 3), (0, 2, 5), (1, 1, 4)], "doc_id long, rev long, words long")
    pages = {r.doc_id: r.html for r in P.pages(metrics, review, W.tops_by_document(f), trend).collect()}
    assert "spoke &lt;softly&gt; &amp; quickly left" in pages[0] and "<softly>" not in pages[0] and pages[1].endswith("</html>")
    assert "1 of 2 findings" in pages[0] and ">0:1:11</span>" in pages[0] and "polyline" in pages[0] and "polyline" not in pages[1]
    assert "<li>spoke <b>1</b></li>" in pages[0] and '<p class="muted">None</p>' in pages[1]
    bare = P.pages(A.counts(f)).filter("doc_id = 0").first().html
    assert '<span class="value">5</span><span class="label">words</span>' in bare and "Review next" not in bare


def test_empty_quotes_are_no_dialogue(spark):
    assert [r.in_dialogue for r in frames(spark, 'Then "" said he. "Go," he said.').words.orderBy("pos").collect()] == [False, False, False, True, False, False]


def test_stream(spark, tmp_path):
    versions = spark.createDataFrame([(1, "2024-01-01 00:00:00", "He left quietly."), (1, "2024-01-01 00:01:00", "He left slowly."), (2, "2024-01-01 00:00:00", "Gone.")], "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    source, out, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    versions.coalesce(1).write.parquet(source)
    run = lambda: reanalyse(spark.readStream.schema(versions.schema).parquet(source), lambda f: A.adverbs(f.words), out, place).awaitTermination()
    run()
    assert [(r.doc_id, r.message) for r in spark.read.parquet(out).collect()] == [(1, "slowly")]
    versions.filter("doc_id = 1").coalesce(1).write.mode("append").parquet(source)  # seen before: nothing to do
    run()
    assert [(r.doc_id, r.message) for r in spark.read.parquet(out).collect()] == [(1, "slowly")]
    back = spark.createDataFrame([(1, "2024-01-01 00:02:00", "He left quietly.")], "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    back.coalesce(1).write.mode("append").parquet(source)  # an earlier content again is a change
    run()
    late = back.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:01:30"))).withColumn("text", F.lit("He left loudly."))
    late.coalesce(1).write.mode("append").parquet(source)  # older than the last version: passed over
    run()
    found = [(r.doc_id, r.message) for r in spark.read.parquet(out).orderBy("batch").collect()]
    assert found == [(1, "slowly"), (1, "quietly")]
    later = late.withColumn("doc_id", F.lit(3).cast("long")).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 05:00:00")))
    later.coalesce(1).write.mode("append").parquet(source)  # the watermark passes: what is known of document 1 is dropped
    run()
    same = back.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 05:30:00")))
    same.coalesce(1).write.mode("append").parquet(source)
    run()
    found = [(r.doc_id, r.message) for r in spark.read.parquet(out).orderBy("batch").collect()]
    assert found == [(1, "slowly"), (1, "quietly"), (3, "loudly"), (1, "quietly")]


def lines(df):
    return [r.line for r in df.orderBy("n").collect()]


def test_listings(spark):
    counts = spark.createDataFrame([("the", 12), ("éa", 3), ("b", 3), (None, 1)], "word string, count long")
    assert lines(G.ranked(counts, "word", "word", 3, 100)) == ["word  count  per 1k", "────  ─────  ──────", "the      12   120.0", "b         3    30.0", "éa        3    30.0", "… 1 more"]
    assert lines(G.ranked(counts, "word", "longer", 9))[-1] == "            1" and lines(G.ranked(counts.limit(0), "word", "word", 3)) == ["Nothing found."]
    assert lines(G.aligned(counts.select("count", "word"), ["count", "word"])) == ["count  word", "─────  ────", "1      ", "3      b", "3      éa", "12     the"]
    f = frames(spark, "He spoke softly.\nSoftly.")
    assert lines(G.listed(L.located(f))) == ["0:1:10  adverbs  softly", "    He spoke softly.", "0:2:1  adverbs  softly", "    Softly.", "0:2:1  echo  softly again after 1 words", "    Softly."]
    one = spark.createDataFrame([(59.4, 0, 2.0), (125.0, -3, 1.255), (59.6, 1234567, 0.0)], "m double, n long, v double")
    shown = [tuple(r) for r in one.select(G.minutes(F.col("m")), G.signed(F.col("n")), G.trimmed(F.col("v")), G.thousands(F.col("n"))).collect()]
    assert [s[0] for s in shown] == ["59 min", "2h 05m", "1h 00m"] and [s[1] for s in shown] == ["+0", "-3", "+1234567"] and [s[2] for s in shown][::2] == ["2", "0"] and shown[2][3] == "1,234,567"
