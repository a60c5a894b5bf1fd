"""Words by the word boundary standard, against another implementation of it and against its rules' examples."""

from __future__ import annotations

import random

import regex
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: Texts and their words, a line for each rule.
RULES = [
    ("can't stop e.g. now", ["can't", "stop", "e.g", "now"]),  # WB6, WB7
    ("3.14 x2 2x 1,000.5a a:b 1:2c", ["x2", "2x", "1,000.5a", "a:b", "2c"]),  # WB8 to WB12
    ("co­op می‌خواهم été", ["co­op", "می‌خواهم", "été"]),  # WB4
    ("日本語 ひらがな", ["日", "本", "語", "ひ", "ら", "が", "な"]),  # no letters there: each by itself
    ("カタカナabc ｶﾀ_ab", ["カタカナ", "abc", "ｶﾀ_ab"]),  # WB13, WB13a, WB13b
    ("א\"ב ג' ד\"", ['א"ב', "ג'", "ד"]),  # WB7a to WB7c
    ("_a_ snake_case a b x² Ⅷth", ["_a_", "snake_case", "a b", "x", "Ⅷth"]),
    ("한국어 ไท", ["한국어", "ไ", "ท"]),
    ("well-known a‑b 10-year-old a-1-b-c- 3.5-fold x-9 été-日本", ["well-known", "a‑b", "year-old", "a", "b-c", "fold", "x", "été-日", "本"]),  # hyphens join words, beyond the standard
]


def of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.words(F.col("t")).alias("w")).collect()
    return [r.w for r in sorted(rows)]


def test_rules(spark):
    assert of(spark, [t for t, _ in RULES]) == [w for _, w in RULES]


CLASSES = ("ALetter", "Hebrew_Letter", "Numeric", "Katakana", "ExtendNumLet", "Extend", "Format", "ZWJ", "MidLetter", "MidNumLet", "MidNum", "Single_Quote", "Double_Quote", "Newline", "CR", "LF")


def by_the_rules(text: str) -> list[str]:
    """Words by the standard's rules, place by place, over its property of each character."""
    kind = [next((c for c in CLASSES if regex.match(rf"\p{{Word_Break={c}}}", x)), "Other") for x in text]
    ignored, ends = ("Extend", "Format", "ZWJ"), ("Newline", "CR", "LF")
    letter, quote = ("ALetter", "Hebrew_Letter"), ("MidNumLet", "Single_Quote")

    def back(i: int) -> int:
        while i >= 0 and kind[i] in ignored and i > 0 and kind[i - 1] not in ends:
            i -= 1
        return i

    def on(i: int) -> int:
        while i < len(text) and kind[i] in ignored:
            i += 1
        return i

    def joined(i: int) -> bool:
        if kind[i - 1] in ends or kind[i] in ends:
            return False
        if kind[i] in ignored:
            return True
        p = back(i - 1)
        a, b = kind[p], kind[i]
        before = kind[q] if p > 0 and (q := back(p - 1)) >= 0 else ""
        after = kind[n] if (n := on(i + 1)) < len(text) else ""
        if a in letter and b in letter or a in letter and b == "Numeric" or a == "Numeric" and b in ("Numeric", *letter):
            return True
        if a in letter and b in ("MidLetter", *quote) and after in letter or before in letter and a in ("MidLetter", *quote) and b in letter:
            return True
        if a == "Hebrew_Letter" and (b == "Single_Quote" or b == "Double_Quote" and after == a) or before == b == "Hebrew_Letter" and a == "Double_Quote":
            return True
        if before == b == "Numeric" and a in ("MidNum", *quote) or a == after == "Numeric" and b in ("MidNum", *quote):
            return True
        run = (*letter, "Numeric", "Katakana", "ExtendNumLet")
        return a == b == "Katakana" or a in run and b == "ExtendNumLet" or a == "ExtendNumLet" and b in run[:-1]

    out, start = [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not joined(i):
            out.append(text[start:i])
            start = i
    words: list[str] = []
    for i, w in enumerate(out):
        if regex.search(r"\p{Alphabetic}", w):
            if i > 1 and out[i - 1] in ("-", "‐", "‑") and words and words[-1].endswith(out[i - 2]) and regex.search(r"\p{Alphabetic}", out[i - 2]):
                words[-1] += out[i - 1] + w
            else:
                words.append(w)
    return words


def test_against_the_rules(spark):
    r = random.Random(1)
    odd = "ab1.2,'’:;_‿ カタアー日本ひらกขא\"é́̈­‍²½Ⅷ٣٤٫한글ß․€а-‑ \n"
    plain = "abzÉßñ019.,:;'’‘·_ -‐!?()“”…ªº¼"
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(1, 14))) for pool in (odd, plain) for _ in range(6000)]
    assert by_the_rules("can't 3.14a") == ["can't", "3.14a"]
    for text, found in zip(texts, of(spark, texts), strict=True):
        assert found == by_the_rules(text), ascii(text)


def test_plain_texts_take_the_short_way_with_the_same_result(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abzÉßñ019.,:;'’‘·_ -‑!?()“”…ªº\n") for _ in range(r.randrange(1, 20))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    same = F.regexp_extract_all("t", F.lit(f"({T.WORD})"), F.lit(1)) == F.regexp_extract_all("t", F.lit(f"({T.WORD_ANY})"), F.lit(1))
    assert rows.filter(F.col("t").rlike(T.ODD)).isEmpty() and rows.filter(~same).isEmpty()
