"""Text functions as column expressions: folding, stems, syllables, letters, segmentation. No Python runs on the data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import ABBREVIATIONS, SYLLABLE_EXCEPTIONS

#: A private-use mark before each word inside dialogue, and one between pieces of a text.
SPOKEN, SPLIT = "\ue000", "\u0001"
#: White space as patterns have it.
BLANKS = " \t\n\x0b\f\r"
TOK = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=[\p{L}\p{M}])[.:'’‘·](?=\p{L})|(?<=\p{N})[.,;'’‘](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
# Classes of the word boundary standard (UAX #29) as sets of characters.
_NO_LETTER = r"\p{IsIdeographic}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsAhom}"
_KATAKANA_RANGES = r"〱-〵゛゜゠-ヺー-ヿㇰ-ㇿ㋐-㋾㌀-㍗ｦ-ﾝ\x{1AFF0}-\x{1AFFE}\x{1B000}\x{1B120}-\x{1B122}\x{1B164}-\x{1B167}"
_KATAKANA = f"[{_KATAKANA_RANGES}]"
_HEBREW = r"[א-תׯ-ײיִײַ-ﬨשׁ-ﭏ]"
_LETTER = rf"[A-Za-zÀ-ÖØ-öø-ɏ[\p{{IsAlphabetic}}&&[^\p{{M}}{_KATAKANA_RANGES}{_NO_LETTER}]]]"
_DIGIT = r"[0-9[\p{Nd}٫]]"
_JOINER = r"[_[\p{Pc} ]]"
_EXTENDER = r"[\p{M}‌‍ﾞﾟ\x{1F3FB}-\x{1F3FF}[\p{Cf}&&[^​]]]"
_EXTEND = f"{_EXTENDER}*+"
_MID_LETTER = r"['.:··՟״‘’․‧︓﹒﹕＇．：]"
_MID_DIGIT = r"['.,;;։،؍٬߸‘’․⁄︐︔﹐﹒﹔＇，．；]"
#: Letters and digits in runs, with marks between two of a kind, and what extends a character; then katakana; then words of joiners.
_RUNS = (
    rf"(?:(?:{_LETTER}++{_EXTEND})++(?:{_MID_LETTER}{_EXTEND}(?={_LETTER})|(?<={_HEBREW}{_EXTENDER}{{0,16}})\"{_EXTEND}(?={_HEBREW}))?"
    rf"|(?:{_DIGIT}++{_EXTEND})++(?:{_MID_DIGIT}{_EXTEND}(?={_DIGIT}))?)++"
)
_KATAKANA_RUN, _JOINERS = f"(?:{_KATAKANA}++{_EXTEND})++", f"(?:{_JOINER}{_EXTEND})++"
_PART = f"(?:{_RUNS}|{_KATAKANA_RUN})"
#: A word by the standard's rules WB4 to WB13; an alphabetic character that is no letter there (an ideograph, say) is one by itself.
TOK_ANY = rf"(?:(?:{_JOINERS})?+{_PART}(?:{_JOINERS}{_PART})*+(?:{_JOINERS}|(?<={_HEBREW}{_EXTENDER}{{0,16}})'{_EXTEND})?+|\p{{IsAlphabetic}}{_EXTEND})"
#: A character for which TOK, the same rules over Latin letters and digits, is not enough.
ODD = "[\\x{80}-\\x{10FFFF}&&[^\\u0000-\\u00AC\\u00AE-\\u00B1\\u00B4-\\u00B8\\u00BA\\u00BB\\u00BF-\\u024F\\u2010-\\u201F\\u2026\\u20AC]]"
# A word has a letter, and hyphens join words alone: what is looked ahead over are digits, joiners and the marks between digits.
_LETTERED = r"(?=(?:[\p{N}_]|(?<=\p{N})[.,;'’‘](?=\p{N}))*+\p{IsAlphabetic})"
_NUMBER = rf"(?:(?:{_DIGIT}++{_EXTEND})++(?:{_MID_DIGIT}{_EXTEND}(?={_DIGIT}))?)++"
_LETTERED_ANY = rf"(?=\p{{IsAlphabetic}}|(?:{_JOINERS})?+(?:{_NUMBER}{_JOINERS})*+(?:(?:{_NUMBER})?+{_LETTER}|{_KATAKANA}))"
WORD = f"{SPOKEN}?{_LETTERED}{TOK}(?:[-‐‑]{SPOKEN}?{_LETTERED}{TOK})*"
WORD_PLAIN = f"{SPOKEN}?{TOK}(?:[-‐‑]{SPOKEN}?{TOK})*"
WORD_ANY = f"{SPOKEN}?{_LETTERED_ANY}{TOK_ANY}(?:[-‐‑]{SPOKEN}?{_LETTERED_ANY}{TOK_ANY})*"
BOUND = rf"([.!?…‽]+[\"'”’)\]»*_]*)(\s+)(?={SPOKEN}?[\p{{IsUppercase}}0-9]|[\"'“‘(\[«¿¡])"
#: WORD_PLAIN for texts without the mark, which are not looked at for it place by place.
WORD_BARE = WORD_PLAIN.replace(f"{SPOKEN}?", "")
#: WORD, WORD_PLAIN and BOUND over ASCII alone, where they give the same: a class of one table instead of a chain of unions.
WIDE = "[^\\x00-\\x7F]"
_TOK_ASCII = r"\w+(?:(?:(?<=[A-Za-z])[.:'](?=[A-Za-z])|(?<=[0-9])[.,;'](?=[0-9]))\w+)*"
_LETTERED_ASCII = r"(?=(?:[0-9_]|(?<=[0-9])[.,;'](?=[0-9]))*+[A-Za-z])"
WORD_ASCII = f"{_LETTERED_ASCII}{_TOK_ASCII}(?:-{_LETTERED_ASCII}{_TOK_ASCII})*"
WORD_PLAIN_ASCII = f"{_TOK_ASCII}(?:-{_TOK_ASCII})*"
BOUND_ASCII = r"([.!?]+[\"')\]*_]*)(\s+)(?=[A-Z0-9]|[\"'(\[])"
SPEECH = "([\"“«])([^\"“”«»]*)([\"”»]|$)"


def fold(word: Column) -> Column:
    lower = F.lower(word)
    return F.when(F.octet_length(word) == F.length(word), lower).otherwise(F.translate(lower, "’‘ʼ‐‑", "'''--"))


def is_capitalised(word: Column) -> Column:
    """Whether a word begins with an upper-case letter; one look at its first byte where it is of ASCII."""
    return F.when(F.octet_length(word) == F.length(word), (word >= "A") & (word < "[")).otherwise(word.rlike(r"^\p{IsUppercase}"))


def one_of(word: Column, entries: Iterable[str]) -> Column:
    return word.isin(sorted(set(entries)))


def stem(word: Column) -> Column:
    """Drops a possessive, then the first plural ending that fits; words of up to three bytes stay."""
    w = F.when(word.endswith("'s"), F.regexp_replace(word, "'s$", "")).otherwise(word)
    rest = (
        F.when(~w.endswith("s"), w)
        .when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when(w.endswith("sses"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("(ch|sh|x)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )
    return F.when(F.octet_length(w) <= 3, w).otherwise(rest)


def latin(lower: Column) -> Column:
    """The letters a to z of a lower-case word."""
    return F.when(lower.rlike("[^a-z]"), F.regexp_replace(lower, "[^a-z]", "")).otherwise(lower)


def voiced(w: Column) -> Column:
    """Letters without a silent ending and a leading y."""
    silent = (w.endswith("es") & ~w.rlike("(s|z|c|g|x|sh|ch)es$")) | (w.endswith("ed") & ~w.rlike("[td]ed$"))
    mute = w.endswith("e") & ~w.rlike("(le|ee)$")
    size = F.length(w) - F.when(silent, 2).when(mute, 1).otherwise(0)
    y = w.startswith("y").cast("int")
    return F.substring(w, y + 1, size - y)


def syllable_count(lower: Column, w: Column, voiced: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in SYLLABLE_EXCEPTIONS.items() for x in (k, int(v))])
    counted = F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.size(F.regexp_extract_all(voiced, F.lit("[aeiouy]+"), F.lit(0))), F.lit(1)))
    return F.coalesce(F.when(lower.isin(list(SYLLABLE_EXCEPTIONS)), F.element_at(known, lower)), counted)


def with_syllables(words: DataFrame, word: str, name: str) -> DataFrame:
    """The frame with the syllables of column `word`. Each step is a column of its own, so that Catalyst computes it once."""
    steps = words.withColumn("__lower", F.lower(word)).withColumn("__latin", latin(F.col("__lower"))).withColumn("__voiced", voiced(F.col("__latin")))
    return steps.withColumn(name, syllable_count(F.col("__lower"), F.col("__latin"), F.col("__voiced"))).drop("__lower", "__latin", "__voiced")


def letters(word: Column) -> Column:
    return F.when(word.rlike("[^A-Za-z0-9]"), F.length(F.regexp_replace(word, r"[^\p{IsAlphabetic}\p{N}]", ""))).otherwise(F.length(word))


def is_complex(word: Column, syllables: Column) -> Column:
    """Three syllables or more, no hyphen, not capitalised."""
    return (syllables >= 3) & ~word.contains("-") & ~word.rlike(r"^\p{IsUppercase}")


def is_adverb_shape(lower: Column) -> Column:
    return lower.endswith("ly") & (F.octet_length(lower) > 4)


def is_regular_participle(lower: Column) -> Column:
    return lower.endswith("ed") & (F.octet_length(lower) > 3)


def per_thousand(n: Column, words: Column) -> Column:
    return F.when(words == 0, F.lit(0.0)).otherwise(n * 1000.0 / words)


def slug(title: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(title), r"[^\p{IsAlphabetic}\p{N}]+", "-"), F.lit("-"))
    return F.when(s == "", "untitled").otherwise(s)


def looks_like_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def hunk_range(header: Column) -> Column:
    """struct(start, count) of the new side of a unified-diff hunk header."""
    part = lambda k: F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", k)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("start"), F.when(part(2) == "", 1).otherwise(part(2).cast("int")).alias("count")))


def is_chapter_label(title: Column) -> Column:
    number = "(?:\\d+|[ivxlcdm]+|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[- ](?:one|two|three|four|five|six|seven|eight|nine))?)"
    return (F.octet_length(title) <= 120) & F.lower(F.trim(title)).rlike(rf"^(?:prologue|epilogue|chapter\s+{number})\b")


def excerpt(text: Column, most: int) -> Column:
    """White space flattened; the middle cut out of what is longer than `most` characters."""
    flat = F.trim(F.when(text.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(text, r"\s+", " ")).otherwise(text))
    half = (most - 3) // 2
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, half), F.lit(" … "), F.expr("''") if half < 1 else F.substring(flat, -half, half)))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def bar(value: Column, most: Column, width: int) -> Column:
    """A bar of eighth blocks, rounded up."""
    eighths = F.when(most <= 0, 0).otherwise(F.ceil(value / most * width * 8)).cast("int")
    part = F.array(*[F.lit(x) for x in ["", "▏", "▎", "▍", "▌", "▋", "▊", "▉"]])
    return F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), F.element_at(part, (eighths % 8 + 1).cast("int")))


def paragraphs(prose: Column) -> Column:
    """Stretches of lines between blank lines."""
    return F.filter(F.split(prose, r"\n(?:[^\S\n]*\n)+"), lambda p: p.rlike(r"\S"))


def mark_speech(paragraph: Column) -> Column:
    """Puts SPOKEN before each word of the dialogue in a paragraph.

    Curly and angle quotes always (re)open it, straight quotes open and close it, unclosed dialogue runs to the end.
    """
    cut = F.split(F.regexp_replace(paragraph, SPEECH, f"$1{SPLIT}$2{SPLIT}$3"), SPLIT)
    said = F.transform(cut, lambda part, i: F.when(i % 2 == 1, F.when(part.rlike(ODD), F.regexp_replace(part, f"({TOK_ANY})", f"{SPOKEN}$1")).otherwise(F.regexp_replace(part, f"({TOK})", f"{SPOKEN}$1"))).otherwise(part))
    return F.when(paragraph.rlike("[\"“«]"), F.array_join(said, "")).otherwise(paragraph)


def has_speech(text: Column) -> Column:
    return text.contains('"') | text.contains("“") | text.contains("«")


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(SPOKEN), F.lit(""))


def ends_in_abbreviation(piece: Column) -> Column:
    """Whether a piece ends in one full stop, without closers, after an initial, a dotted word or a listed abbreviation.

    The cheap test comes first; the last token is cut out once, as the element of an array of one.
    """
    token = F.regexp_replace(unmarked(F.regexp_extract(piece, r"(?<!\S)(\S*)\.$", 1)), r"^[^\p{IsAlphabetic}\p{N}]+", "")
    listed = lambda t: t.rlike(r"^\p{IsUppercase}$") | t.contains(".") | one_of(F.lower(t), ABBREVIATIONS)
    return piece.endswith(".") & F.exists(F.array(token), listed) & ~piece.rlike(r"[.!?…‽][\"'”’)\]»*_]*[.]$")


def sentences(paragraph: Column) -> Column:
    """The sentences of a paragraph in turn; joined, they are the paragraph."""
    marked = lambda bound: F.regexp_replace(paragraph, bound, f"$1{SPLIT}$2")
    pieces = F.split(F.when(paragraph.rlike(WIDE), marked(BOUND)).otherwise(marked(BOUND_ASCII)), SPLIT)
    whole = F.array_join(F.transform(pieces, lambda p: F.when(ends_in_abbreviation(p), p).otherwise(F.concat(p, F.lit(SPLIT)))), "")
    return F.split(whole, SPLIT)


def words(sentence: Column) -> Column:
    """Words by the word boundary standard, with at least one letter; hyphens join words.

    Only a sentence with an ODD character needs the full rules, and only one with numbers, underscores or marks the look for a letter.
    Sentences of ASCII alone take the same patterns over ASCII.
    """
    of = lambda pattern: F.regexp_extract_all(sentence, F.lit(f"({pattern})"), F.lit(1))
    ascii_only = F.when(sentence.rlike("[0-9_]"), of(WORD_ASCII)).otherwise(of(WORD_PLAIN_ASCII))
    wide = F.when(sentence.rlike(rf"[\p{{N}}_{SPOKEN}]"), of(WORD)).otherwise(of(WORD_BARE))
    return F.when(~sentence.rlike(WIDE), ascii_only).when(sentence.rlike(ODD), of(WORD_ANY)).otherwise(wide)


def split_words(text: Column) -> Column:
    """The text cut before and behind each word: gaps and words in turn."""
    by = lambda pattern: F.regexp_replace(text, f"({pattern})", f"{SPLIT}$1{SPLIT}")
    return F.split(F.when(~text.rlike(WIDE), by(WORD_ASCII)).when(text.rlike(ODD), by(WORD_ANY)).otherwise(by(WORD)), SPLIT)
