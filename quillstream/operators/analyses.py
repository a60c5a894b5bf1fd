"""The analyses: each takes frames (and its parameters) and returns a DataFrame, one row a document, section or finding."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as T
from .frames import Frames
from .lineage import cut


def sizes() -> list[Column]:
    """Paragraphs and characters with and without white space, out of a segmentation."""
    solid = lambda p: F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), T.BLANKS, p["text"]))
    trimmed = lambda p: F.length(F.trim(p["text"], F.lit(T.BLANKS)))
    return [F.size(F.array_distinct(F.transform("sents", lambda s: s["para"]))).alias("paragraphs"), F.aggregate("paras", F.lit(0), lambda a, p: a + solid(p)).alias("solid"), F.aggregate("paras", F.lit(0), lambda a, p: a + trimmed(p)).alias("characters")]


def counted() -> list[Column]:
    """The columns of counts(), out of words, sentences and sizes()."""
    words = F.col("words").cast("long")
    return [words.alias("words"), F.col("characters").cast("long").alias("characters"), F.col("solid").cast("long").alias("characters_no_space"), F.col("sentences").cast("long").alias("sentences"), F.col("paragraphs").cast("long").alias("paragraphs"), F.round(words / 238, 4).alias("reading_minutes"), F.round(words / 150, 4).alias("speaking_minutes")]


def counts(f: Frames) -> DataFrame:
    """Words, characters with and without white space, sentences, paragraphs, and minutes to read and to speak a document."""
    out = f.cut.select("doc_id", F.aggregate("sents", F.lit(0), lambda a, s: a + F.size(s["words"])).alias("words"), F.size("sents").alias("sentences"), *sizes())
    return out.select("doc_id", *counted())


def frequency(words: DataFrame, min_length: int = 1, stopwords: bool = False) -> DataFrame:
    kept = words if stopwords else words.filter(~T.one_of(F.col("lower"), V.STOPWORDS))
    return kept.filter(F.length("lower") >= min_length).groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("count"))


def hapax(words: DataFrame) -> DataFrame:
    """Words that occur once in the whole corpus, with their place."""
    once = words.groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("pos").cast("long").alias("pos"))
    return once.filter("n = 1").drop("n")


def diversity(words: DataFrame, window: int = 50, *keys: str) -> DataFrame:
    """Type-token ratio and its moving average. Each word counts in as many windows as it is the first of its kind in."""
    keys = keys or ("doc_id",)
    before = F.lag("pos").over(Window.partitionBy(*keys, "lower").orderBy("pos"))
    n = F.count("*").over(Window.partitionBy(*keys))
    seen = words.select(*keys, "lower", "pos", before.alias("before")).withColumn("words", n)
    past = F.coalesce("before", F.lit(-1))
    last = F.least(F.col("pos"), F.col("words") - window)
    first_in = F.greatest(last - F.greatest(past + 1, F.col("pos") - window + 1, F.lit(0)) + 1, F.lit(0))
    total = seen.groupBy(*keys).agg(F.first("words").alias("words"), F.count_if(F.col("before").isNull()).alias("unique"), F.sum(first_in).alias("firsts"))
    ttr = F.col("unique") / F.col("words")
    moving = F.col("firsts") / (F.col("words") - window + 1) / F.lit(max(window, 1))
    mattr = F.when((F.col("words") <= window) | F.lit(window == 0), ttr).otherwise(moving)
    return total.select(*keys, "words", "unique", F.round(ttr + 1e-9, 4).alias("ttr"), F.round(mattr + 1e-9, 4).alias("mattr"))


def histogram(values: DataFrame, width: int, cap: int) -> DataFrame:
    """(low, high, count) of column `value` in buckets of `width`, the last one open; empty buckets inside are kept."""
    bucket = F.least(F.floor(F.col("value") / width), F.lit(cap // width)).cast("int")
    found = values.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count")).filter("bucket is not null")
    # the buckets, cap // width + 1 at most, become one row, so that the values are made once and not for their ends as well
    one = found.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.map_from_entries(F.collect_list(F.struct("bucket", "count"))).alias("of")).filter("a is not null")
    every = one.select(F.explode(F.sequence("a", "b")).alias("bucket"), "of").withColumn("count", F.element_at("of", F.col("bucket")))
    low = F.col("bucket") * width
    return every.select(low.cast("long").alias("low"), F.when(low < cap, (low + width - 1).cast("long")).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def summary(values: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, median, population deviation and ends of column `value`."""
    return values.groupBy(*keys).agg(F.count("*").alias("count"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.round(F.stddev_pop("value"), 4).alias("stdev"), F.min("value").cast("long").alias("min"), F.max("value").cast("long").alias("max"))


def overused(words: DataFrame, baseline: DataFrame, min_ratio: float = 3.0, min_count: int = 3, *keys: str) -> DataFrame:
    """Words far more frequent than in the baseline (word, per_million); words that it lacks are skipped.

    Frequencies are those of all words together, or of each group of `keys`.
    """
    kept = words.filter(~T.one_of(F.col("lower"), V.STOPWORDS))
    counts = kept.groupBy(*keys, F.col("lower").alias("word")).agg(F.count("*").alias("count"))
    if keys:
        counts = counts.withColumn("all", F.sum("count").over(Window.partitionBy(*keys)))
    else:
        counts = counts.withColumn("all", F.lit(counts.agg(F.sum("count")).first()[0] or 1))
    return beyond(counts.filter(F.col("count") >= min_count), baseline, min_ratio, *keys)


def beyond(counts: DataFrame, baseline: DataFrame, min_ratio: float = 3.0, *keys: str) -> DataFrame:
    """(keys..., word, count, ratio) of counted words (keys..., word, count, all) that are min_ratio times as frequent as in the baseline."""
    both = counts.join(baseline, "word")
    rate = F.col("count") / F.col("all") * 1e6
    return both.select(*keys, "word", "count", F.round(rate / F.col("per_million"), 4).alias("ratio")).filter(F.col("ratio") >= min_ratio)


def phrase_findings(sentences: DataFrame, rules: dict[str, Iterable[str]]) -> DataFrame:
    """(doc_id, rule, message, sent, pos, n) of greedy longest, non-overlapping matches of folded phrases inside sentences.

    rules: phrases by rule. A sentence's folded words stand between double spaces, so one alternation a rule, longest first,
    finds whole words only. All rules are looked for in one pass. pos is the first word's place in the document, n its words.
    """
    folded = T.fold(F.concat(F.lit("  "), F.array_join("words", "  "), F.lit("  ")))
    cuts = []
    for rule, phrases in rules.items():
        entries = sorted({p.lower() for p in phrases}, key=lambda p: (-len(p.split()), p))
        if entries:
            pattern = "|".join("  ".join(re.escape(w) for w in p.split()) for p in entries)
            parts = F.split(F.regexp_replace("folded", f" ({pattern})(?= )", f" {T.SPLIT}$1{T.SPLIT}"), T.SPLIT)
            cuts.append(F.struct(F.lit(rule).alias("rule"), parts.alias("parts")))
    one = sentences.select("doc_id", "sent", "first", folded.alias("folded"))
    cuts = F.array(*cuts) if cuts else F.array().cast("array<struct<rule:string,parts:array<string>>>")
    hits = one.select("doc_id", "sent", "first", F.explode(F.filter(cuts, lambda x: F.size(x["parts"]) > 1)).alias("x"))
    hits = hits.select("doc_id", "sent", "first", "x.rule", "x.parts", F.posexplode("x.parts").alias("i", "hit")).filter("i % 2 = 1")
    n_words = lambda p: F.size(F.filter(F.split(p, " +"), lambda w: w != ""))
    at = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0), lambda a, p: a + n_words(p))
    message = F.regexp_replace("hit", "  ", " ")
    return hits.select("doc_id", "rule", message.alias("message"), F.col("sent").cast("long").alias("sent"), (F.col("first") + at).alias("pos"), n_words(F.col("hit")).cast("long").alias("n"))


def with_verbs(findings: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Findings whose message, for the rule `nominal`, also names the verb of a table noun -> verb."""
    table = V.NOMINALIZATIONS if table is None else table
    if not table:
        return findings
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("message"))
    return findings.withColumn("message", F.when(F.col("rule") == "nominal", F.concat_ws(" -> ", "message", verb)).otherwise(F.col("message")))


def nominalizations(sentences: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    return with_verbs(phrase_findings(sentences, {"nominal": V.NOMINALIZATIONS if table is None else table}), table)


def adverbs(words: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    kept = words.filter(T.is_adverb_shape(F.col("lower")) & ~T.one_of(F.col("lower"), [*V.NOT_ADVERBS, *extra]))
    return kept.select("doc_id", F.lit("adverbs").alias("rule"), F.col("lower").alias("message"), F.col("sent").cast("long").alias("sent"), F.col("pos").cast("long").alias("pos"), F.lit(1).cast("long").alias("n"))


def adverbs_of(sentences: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """The rows of adverbs(), out of sentences: only words in -ly are taken out of them."""
    ly = F.filter(F.transform("words", lambda w, j: F.when(F.lower(w).endswith("ly"), F.struct(j.alias("j"), T.fold(w).alias("lower")))), lambda x: x.isNotNull())
    hits = sentences.select("doc_id", "sent", "first", F.explode(ly).alias("x"))
    kept = hits.filter(T.is_adverb_shape(F.col("x.lower")) & ~T.one_of(F.col("x.lower"), [*V.NOT_ADVERBS, *extra]))
    return kept.select("doc_id", F.lit("adverbs").alias("rule"), F.col("x.lower").alias("message"), F.col("sent").cast("long").alias("sent"), (F.col("first") + F.col("x.j")).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"))


def passive(sentences: DataFrame) -> DataFrame:
    """A be-verb, at most one -ly word, a participle, and a `by` after it; the scan goes on behind a match.

    Words become classes in a string (one letter a word), a regular expression over it finds the matches left to right.
    """
    w = lambda x: T.fold(x)
    participle = lambda x: T.one_of(x, V.IRREGULAR_PARTICIPLES) | T.is_regular_participle(x)
    kind = lambda x: F.when(T.one_of(x, V.BE_VERBS) & participle(x), "B").when(T.one_of(x, V.BE_VERBS), "b").when(T.one_of(x, V.ADJECTIVAL_PARTICIPLES), "a").when(participle(x), "p").when(x == "by", "y").when(x.endswith("ly"), "l").otherwise("-")
    folded = F.transform("words", w)
    listed = lambda words: "|".join(map(re.escape, sorted(words)))
    # few sentences have a be-verb and such a word behind it: a look at all words at once spares the others one by one
    likely = f" (?:{listed(V.BE_VERBS)}) (?:[^ ]*ly )?(?:[^ ]*ed|{listed({*V.IRREGULAR_PARTICIPLES, *V.ADJECTIVAL_PARTICIPLES})}) "
    joined = T.fold(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    one = sentences.filter(joined.rlike(likely)).select("doc_id", "sent", "first", folded.alias("folded"))
    one = one.withColumn("kinds", F.array_join(F.transform("folded", kind), ""))
    marked = F.regexp_replace("kinds", "([bB]l?(?:[pB]y?|ay))", "<$1>")
    one = one.withColumn("parts", F.split(marked, "[<>]"))
    hits = one.select("doc_id", "sent", "first", "folded", "parts", F.posexplode("parts").alias("i", "part")).filter("i % 2 = 1")
    start = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0), lambda a, p: a + F.length(p))
    message = F.array_join(F.slice("folded", start + 1, F.length("part")), " ")
    return hits.select("doc_id", F.lit("passive").alias("rule"), message.alias("message"), F.col("sent").cast("long").alias("sent"), (F.col("first") + start).alias("pos"), F.length("part").cast("long").alias("n"))


def proper_nouns(words: DataFrame) -> DataFrame:
    """(doc_id, lower) of words capitalised inside sentences and never lower-case there."""
    inside = words.filter("w_in_sent > 0").groupBy("doc_id", "lower").agg(F.bool_and(F.col("raw").rlike(r"^\p{IsUppercase}")).alias("name"))
    return inside.filter("name").select("doc_id", "lower")


def echoes(words: DataFrame, window: int = 50, min_length: int = 4, ignore: Iterable[str] = (), names: bool = False) -> DataFrame:
    """Content words whose stem came up at most `window` words before; proper nouns don't count unless `names`."""
    content = words.filter((F.length("lower") >= min_length) & ~T.one_of(F.col("lower"), [*V.STOPWORDS, *ignore]))
    content = content.select("doc_id", "sent", "pos", "lower", F.when(F.col("w_in_sent") > 0, F.col("raw").rlike(r"^\p{IsUppercase}")).alias("upper"))
    if not names:
        always = F.min("upper").over(Window.partitionBy("doc_id", "lower"))
        content = content.withColumn("name", F.coalesce(always, F.lit(False))).filter(~F.col("name"))
    w = Window.partitionBy("doc_id", "stem").orderBy("pos")
    seen = content.select("doc_id", "sent", "pos", T.stem(F.col("lower")).alias("stem")).withColumn("distance", F.col("pos") - F.lag("pos").over(w))
    kept = seen.filter(F.col("distance") <= window)
    return kept.select("doc_id", "stem", F.col("sent").cast("long").alias("sent"), F.col("pos").cast("long").alias("pos"), F.col("distance").cast("long").alias("distance"))


def islands(rows: DataFrame, value: Column, order: str, *keys: str) -> DataFrame:
    """Runs of equal values: keys, value, first and last of `order`, and n."""
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = rows.withColumn("__v", value).withColumn("__new", F.when(F.lag("__v").over(w).eqNullSafe(F.col("__v")) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = flagged.withColumn("__run", F.sum("__new").over(w))
    return numbered.groupBy(*keys, "__run").agg(F.first("__v").alias("value"), F.min(order).cast("long").alias("first"), F.max(order).cast("long").alias("last"), F.count("*").alias("n")).drop("__run")


def starter_counts(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy(F.col("first_word").alias("word")).agg(F.count("*").alias("count"))


def paragraph_starter_counts(sentences: DataFrame) -> DataFrame:
    opener = sentences.groupBy("doc_id", "para").agg(F.min_by("first_word", "sent").alias("word"))
    return opener.groupBy("word").agg(F.count("*").alias("count"))


def starter_runs(sentences: DataFrame, run: int = 3) -> DataFrame:
    rows = sentences.withColumn("region", F.coalesce("section", F.lit(-1)))
    return islands(rows, F.col("first_word"), "sent", "doc_id", "region").filter(F.col("n") >= run).withColumnRenamed("value", "word").drop("region")


def tense_sentences(words: DataFrame, dialogue: bool = False) -> DataFrame:
    """(doc_id, sent, tense) of sentences whose narration, or with `dialogue` all of whose words, lean to one tense."""
    past = T.one_of(F.col("lower"), V.PAST_AUX) | T.is_regular_participle(F.col("lower"))
    present = ~past & T.one_of(F.col("lower"), V.PRESENT_AUX)
    told = words if dialogue else words.filter("not in_dialogue")
    n = told.groupBy("doc_id", "sent").agg(F.count_if(past).alias("a"), F.count_if(present).alias("b"))
    return n.filter("a <> b").select("doc_id", F.col("sent").cast("long").alias("sent"), F.when(F.col("a") > F.col("b"), "past").otherwise("present").alias("tense"))


def tense_totals(classified: DataFrame) -> DataFrame:
    n = classified.groupBy("doc_id").agg(F.count_if(F.col("tense") == "past").alias("past_sentences"), F.count_if(F.col("tense") == "present").alias("present_sentences"))
    return n.withColumn("dominant", F.when(F.col("present_sentences") > F.col("past_sentences"), "present").otherwise("past"))


def drift(classified: DataFrame, totals: DataFrame, kind: str, run: int = 3) -> DataFrame:
    """Runs of `run` or more classified sentences of one kind that isn't the document's dominant one."""
    found = islands(classified, F.col(kind), "sent", "doc_id").filter(F.col("n") >= run)
    return found.join(totals.select("doc_id", "dominant"), "doc_id").filter("value <> dominant").drop("dominant")


def pov_sentences(words: DataFrame, dialogue: bool = False) -> DataFrame:
    hit = lambda entries: F.count_if(T.one_of(F.col("lower"), entries))
    told = words if dialogue else words.filter("not in_dialogue")
    n = told.groupBy("doc_id", "sent").agg(hit(V.FIRST_PERSON).alias("a"), hit(V.SECOND_PERSON).alias("b"), hit(V.THIRD_PERSON).alias("c"))
    person = F.expr("CASE WHEN a > b AND a > c THEN 'first' WHEN b > a AND b > c THEN 'second' WHEN c > a AND c > b THEN 'third' END")
    return n.select("doc_id", F.col("sent").cast("long").alias("sent"), person.alias("person")).filter("person is not null")


def pov_totals(classified: DataFrame) -> DataFrame:
    n = classified.groupBy("doc_id").agg(*[F.count_if(F.col("person") == p).alias(f"{p}_sentences") for p in ("first", "second", "third")])
    return n.withColumn("dominant", F.expr("CASE WHEN third_sentences >= first_sentences AND third_sentences >= second_sentences THEN 'third' WHEN second_sentences >= first_sentences THEN 'second' ELSE 'first' END"))


def readability(words: DataFrame, *keys: str) -> DataFrame:
    """The five scores, by document or by any other keys of the words; 1e-9 makes decimal ties round up everywhere."""
    spelt = T.with_syllables(words.select(*keys, "w_in_sent", "raw"), "raw", "y")
    n = spelt.groupBy(*keys).agg(F.count("*").alias("words"), F.count_if(F.col("w_in_sent") == 0).alias("sentences"), F.sum("y").alias("y"), F.count_if(T.is_complex(F.col("raw"), F.col("y"))).alias("hard"), F.sum(T.letters(F.col("raw"))).alias("letters"))
    found = scores(F.col("words"), F.col("sentences"), F.col("y"), F.col("hard"), F.col("letters"))
    return n.select(*keys, "words", "sentences", *[c.alias(name) for name, c in found.items()])


def scores(w: Column, sentences: Column, syllables: Column, hard: Column, letters: Column) -> dict[str, Column]:
    """The five scores by name, out of counts."""
    wps, spw, lpw = w / sentences, syllables / w, letters / w
    return {
        "flesch_reading_ease": F.round(206.835 - 1.015 * wps - 84.6 * spw + 1e-9, 4),
        "flesch_kincaid_grade": F.round(0.39 * wps + 11.8 * spw - 15.59 + 1e-9, 4),
        "gunning_fog": F.round(0.4 * (wps + 100.0 * hard / w) + 1e-9, 4),
        "coleman_liau": F.round(0.0588 * (lpw * 100) - 0.296 * (sentences / w * 100) - 15.8 + 1e-9, 4),
        "automated_readability": F.round(4.71 * lpw + 0.5 * wps - 21.43 + 1e-9, 4),
    }


def long_sentences(sentences: DataFrame, most: int = 40) -> DataFrame:
    return sentences.filter(F.col("n_words") > most).select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("n_words").cast("long").alias("n_words"))


def monotony(sentences: DataFrame, run: int = 4, tolerance: int = 3) -> DataFrame:
    """Runs of `run` or more sentences whose lengths stay within `tolerance` words, greedy from the left in each section.

    One fold over a section's lengths. Where a length doesn't fit, a run that is long enough ends; of a shorter one (fewer
    than `run` lengths are held) the longest end that it fits goes on.
    """
    found = "array<struct<first:int,n:int>>"
    lengths = sentences.withColumn("region", F.coalesce("section", F.lit(-1))).groupBy("doc_id", "region").agg(F.array_sort(F.collect_list(F.struct("sent", "n_words"))).alias("s"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.array().cast("array<int>").alias("held"), F.array().cast(found).alias("runs"))

    def state(first, n, lo, hi, held, runs):
        return F.struct(first.alias("first"), n.alias("n"), lo.alias("lo"), hi.alias("hi"), held.alias("held"), runs.alias("runs"))

    def step(a, x):
        y = x["n_words"]
        lo, hi = F.least(a["lo"], y), F.greatest(a["hi"], y)
        grown = state(a["first"], a["n"] + 1, lo, hi, F.when(a["n"] + 1 < run, F.concat(a["held"], F.array(y))).otherwise(F.array().cast("array<int>")), a["runs"])
        ended = F.when(a["n"] >= run, F.concat(a["runs"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n"))))).otherwise(a["runs"])
        fresh = state(x["sent"], F.lit(1), y, y, F.array(y), ended)
        rest = lambda i: F.concat(F.slice(a["held"], i + 1, F.lit(run)), F.array(y))
        tail = F.filter(a["held"], lambda h, i: F.array_max(rest(i)) - F.array_min(rest(i)) <= tolerance)

        def shorter(t):
            gone = state(a["first"] + a["n"] - F.size(t), F.size(t) + 1, F.least(F.array_min(t), y), F.greatest(F.array_max(t), y), F.concat(t, F.array(y)), a["runs"])
            return F.when(F.size(t) == 0, fresh).otherwise(gone)

        cut_off = F.get(F.transform(F.array(tail), shorter), F.lit(0))  # an array of one, so that the end is looked for once
        return F.when(a["n"] == 0, fresh).when(hi - lo <= tolerance, grown).when(a["n"] >= run, fresh).otherwise(cut_off)

    last = F.aggregate("s", start, step, lambda a: F.when(a["n"] >= run, F.concat(a["runs"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n"))))).otherwise(a["runs"]))
    return lengths.select("doc_id", F.explode(last).alias("r")).select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.n").cast("long").alias("n"))


def cast_mentions(words: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    named = words.join(proper_nouns(words), ["doc_id", "lower"], "left_semi").filter(~T.one_of(F.col("lower"), ["", *ignore]))
    return named.groupBy("doc_id", F.coalesce("section", F.lit(-1)).cast("long").alias("section"), F.col("lower").alias("name")).agg(F.count("*").alias("count"))


def name_counts(words: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """(name, count): how often each proper noun of more than three letters is written, over all documents that have it as one."""
    always = F.min(F.when(F.col("w_in_sent") > 0, F.col("raw").rlike(r"^\p{IsUppercase}"))).over(Window.partitionBy("doc_id", "lower"))
    named = words.filter(F.length("lower") > 3).select("lower", always.alias("name")).filter("name")
    return named.filter(~T.one_of(F.col("lower"), ["", *ignore])).groupBy(F.col("lower").alias("name")).agg(F.count("*").alias("count"))


def name_pairs(names: DataFrame) -> DataFrame:
    """Names that are spelt nearly alike: pairs within the edit distance that the later name allows.

    Blocked by deletions: names within two edits share a string that either gives by up to two deletions, so the join has
    an equality key and no pair of unlike names is ever formed. Two edits count only where the later name has over seven
    letters, so shorter names give up to two deletions as well, to meet longer ones.
    """
    drop1 = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))
    once = drop1(F.col("name"))
    keys = F.array_distinct(F.concat(F.array("name"), once, F.flatten(F.transform(once, drop1))))
    keyed = names.withColumn("key", F.explode(keys))
    a, b = keyed.select(F.col("key"), F.col("name").alias("earlier")), keyed.select(F.col("key"), F.col("name").alias("later"))
    pairs = a.join(b, "key").filter("earlier < later").select("earlier", "later").distinct()
    return pairs.withColumn("distance", F.levenshtein("earlier", "later")).filter(F.col("distance") <= F.when(F.length("later") > 7, 2).otherwise(1))


def name_variants(names: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(lead, total, name, count), most used first: in alphabetical order, a name of names (name, count) joins the first cluster
    all of whose members are near enough. lead is a cluster's most used spelling, total its uses.

    Only names that are near some other are grouped; the greedy pass runs once for each connected group of them, in one task,
    and looks for each name at the clusters of its neighbours alone.
    """
    import pandas as pd

    names = cut(names)
    pairs = cut(name_pairs(names) if pairs is None else pairs)
    links = pairs.select("earlier", "later").unionByName(pairs.select(F.col("later").alias("earlier"), F.col("earlier").alias("later")))
    links = cut(links)
    label = links.groupBy(F.col("earlier").alias("name")).agg(F.least(F.min("later"), F.first("earlier")).alias("label"))
    while True:  # until no label falls: each name takes the least label near it, and that label's own label, so chains halve
        spread = links.join(label.select(F.col("name").alias("later"), "label"), "later").groupBy(F.col("earlier").alias("name")).agg(F.min("label").alias("near"))
        hop = label.select(F.col("name").alias("label"), F.col("label").alias("hop"))
        now = cut(label.join(spread, "name").join(hop, "label", "left").select("name", F.least("label", "near", "hop").alias("label"), (F.least("near", "hop") < F.col("label")).alias("fell")))
        label = now.select("name", "label")
        if now.filter("fell").isEmpty():
            break
    near = pairs.join(label.select(F.col("name").alias("later"), "label"), "later")

    def group(df: pd.DataFrame) -> pd.DataFrame:
        nearby: dict[str, set[str]] = {}
        for a, b in zip(df["earlier"], df["later"], strict=True):
            nearby.setdefault(b, set()).add(a)
        clusters: list[list[str]] = []
        home: dict[str, int] = {}
        for name in sorted(set(df["earlier"]) | set(df["later"])):
            close = nearby.get(name, set())
            fits = [c for c in {home[m] for m in close} if close.issuperset(clusters[c])]
            if fits:
                home[name] = min(fits)
                clusters[home[name]].append(name)
            else:
                home[name] = len(clusters)
                clusters.append([name])
        rows = [(c[0], n) for c in clusters if len(c) > 1 for n in c]
        return pd.DataFrame(rows, columns=["cluster", "name"])

    found = near.groupBy("label").applyInPandas(group, "cluster string, name string").join(names, "name")
    of = found.groupBy("cluster").agg(F.sum("count").alias("total"), F.min(F.struct((-F.col("count")).alias("c"), "name"))["name"].alias("lead"))
    return found.join(of, "cluster").select("lead", "total", "name", "count").orderBy(F.desc("total"), "lead", F.desc("count"), "name")


def dialogue_ratio(words: DataFrame, *keys: str) -> DataFrame:
    n = words.groupBy(*keys).agg(F.count_if("in_dialogue").alias("dialogue_words"), F.count("*").alias("words"))
    return n.withColumn("ratio", F.round(F.col("dialogue_words") / F.col("words"), 4))


def attributions(f: Frames) -> DataFrame:
    """(doc_id, para, nth, said, verb, kind, adverb, speaker) of each stretch of dialogue inside its paragraph.

    The verb is the nearest tag among four words after the quote, else among four before; the speaker is the first name
    among those four, and an -ly word right behind the verb in reading direction makes it qualified.
    """
    f = f.settled()
    paras = f.docs.select("doc_id", F.posexplode("paras").alias("para", "p")).select("doc_id", "para", F.col("p.text").alias("text")).filter(F.col("text").rlike("[\"“«]"))
    parts = F.split(F.regexp_replace("text", T.SPEECH, f"$1{T.SPLIT}$2{T.SPLIT}$3"), T.SPLIT)
    spans = paras.select("doc_id", "para", parts.alias("parts")).select("doc_id", "para", "parts", F.posexplode("parts").alias("i", "said")).filter("i % 2 = 1 and said <> ''")
    fold_all = lambda c: F.transform(T.words(c), lambda w: T.fold(w))
    after = fold_all(F.array_join(F.slice("parts", F.col("i") + 2, F.size("parts")), " "))
    before = F.reverse(fold_all(F.array_join(F.slice("parts", 1, F.col("i")), " ")))
    spans = spans.select("doc_id", "para", ((F.col("i") - 1) / 2).cast("long").alias("nth"), "said", F.slice(after, 1, 5).alias("after"), F.slice(before, 1, 5).alias("before"))
    names = proper_nouns(f.words).groupBy("doc_id").agg(F.collect_set("lower").alias("names"))
    spans = spans.join(names, "doc_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    tags = F.array(*[F.lit(x) for x in (*V.DIALOGUE_TAGS, *V.SAID_BOOKISMS)])
    first_tag = lambda c: F.get(F.filter(F.slice(c, 1, 4), lambda w: F.array_contains(tags, w)), F.lit(0))
    spans = spans.withColumn("near", F.when(first_tag("after").isNotNull(), F.col("after")).when(first_tag("before").isNotNull(), F.col("before")))
    spans = spans.withColumn("verb", first_tag("near"))
    nxt = F.get("near", F.array_position(F.slice("near", 1, 4), F.col("verb")).cast("int"))
    speaker = F.get(F.filter(F.slice("near", 1, 4), lambda w: F.array_contains("names", w)), F.lit(0))
    kind = F.when(T.one_of(F.col("verb"), V.DIALOGUE_TAGS), "plain").when(F.col("verb").isNotNull(), "showy")
    return spans.select("doc_id", F.col("para").cast("long").alias("para"), "nth", "said", "verb", kind.alias("kind"), F.coalesce(nxt.endswith("ly") & ~T.one_of(nxt, V.NOT_ADVERBS), F.lit(False)).alias("adverb"), speaker.alias("speaker"))


def tag_totals(found: DataFrame) -> DataFrame:
    bucket = F.when(F.col("kind").isNull(), "untagged").when(F.col("kind") == "showy", "showy").when(F.col("adverb"), "adverb").otherwise("plain")
    return found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))


def speakers(found: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split("said", r"\s+"), lambda w: w != ""))
    return found.groupBy(F.coalesce("speaker", F.lit("(unattributed)")).alias("speaker")).agg(F.count("*").alias("lines"), F.sum(n).alias("words"))


def outline(f: Frames) -> DataFrame:
    """Words under each heading; a level-0 row for what stands before the first one."""
    f = f.settled()
    n = f.words.groupBy("doc_id", "section").agg(F.count("*").alias("words"))
    heads = f.headings.join(n, ["doc_id", "section"], "left").select("doc_id", F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), "title", F.coalesce("words", F.lit(0)).alias("words"))
    bare = n.filter("section is null").select("doc_id", F.lit(-1).cast("long").alias("section"), F.lit(0).cast("long").alias("level"), F.lit("(before first heading)").alias("title"), "words")
    return heads.unionByName(bare)


def arc(f: Frames) -> DataFrame:
    """Each section's words, dialogue share, mean sentence length, and adverbs and passives with their rates."""
    f = f.settled()
    words, sents = f.words, f.sentences
    key = F.coalesce("section", F.lit(-1)).cast("long").alias("section")
    base = words.groupBy("doc_id", key).agg(F.count("*").alias("words"), F.count_distinct("sent").alias("sentences"), F.count_if("in_dialogue").alias("said"), F.count_if(T.is_adverb_shape(F.col("lower")) & ~T.one_of(F.col("lower"), V.NOT_ADVERBS)).alias("adverbs"))
    found = passive(sents).join(sents.select("doc_id", F.col("sent").cast("long").alias("sent"), key), ["doc_id", "sent"]).groupBy("doc_id", "section").agg(F.count("*").alias("passives"))
    out = base.join(found, ["doc_id", "section"], "left").withColumn("passives", F.coalesce("passives", F.lit(0)))
    rate = lambda c: F.round(T.per_thousand(F.col(c), F.col("words")), 4)
    return out.select("doc_id", "section", "words", F.round(F.col("said") / F.col("words"), 4).alias("dialogue_ratio"), F.round(F.col("words") / F.col("sentences"), 4).alias("mean_sentence_words"), "adverbs", rate("adverbs").alias("adverbs_per_1k"), "passives", rate("passives").alias("passives_per_1k"))


def split_sections(f: Frames, level: int = 1) -> DataFrame:
    """The source from each heading of a level to the next, with a numbered slug for a file name."""
    lines = f.docs.select("doc_id", F.split("source", "\n").alias("lines"), F.filter("headings", lambda h: h["level"] == level).alias("h"))
    ends = F.transform("h", lambda h, i: F.struct(h["title"].alias("title"), h["line"].alias("line"), F.coalesce(F.get("h", i + 1)["line"], F.size("lines") + 1).alias("end")))
    one = lines.select("doc_id", "lines", F.size("h").alias("n"), F.posexplode(ends).alias("i", "e"))
    name = F.concat(F.lpad((F.col("i") + 1).cast("string"), F.greatest(F.length(F.col("n").cast("string")), F.lit(2)), "0"), F.lit("-"), T.slug(F.col("e.title")))
    return one.select("doc_id", (F.col("i") + 1).cast("long").alias("number"), name.alias("name"), F.array_join(F.slice("lines", F.col("e.line"), F.col("e.end") - F.col("e.line")), "\n").alias("source"))


def join_documents(docs: DataFrame, *keys: str, each: int = 1000) -> DataFrame:
    """(keys, part, text): the documents of each key in order of doc_id, trimmed at the end, a blank line between.

    A part holds the documents of `each` successive ids, so no cell grows with the table; parts in turn, a blank line between,
    are the whole. Documents without an id are one part, null, which comes first.
    """
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", "").alias("t"))))
    part = F.floor(F.col("doc_id") / each).alias("part")
    return docs.groupBy(*keys, part).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def per_1k(findings: DataFrame, words: DataFrame) -> DataFrame:
    """Findings by rule, with their rate over all words."""
    total = words.count()
    n = findings.groupBy("rule").agg(F.count("*").alias("count"))
    return n.withColumn("per_1k", F.round(T.per_thousand(F.col("count"), F.lit(total)), 4))
