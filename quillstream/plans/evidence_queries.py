"""Queries over readings by a model, for which plain functions stand in: what they say follows from the prompt alone."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyses as A
from ..operators import readings as E
from ..operators.frames import Frames

#: Bytes of a batch, so that small corpora have several.
MOST = 300_000
LINE = re.compile(r"([^:]+):(\d+)\| (.*)", re.DOTALL)


def _lines(prompt: str) -> list[tuple[str, int, str]]:
    return [(m[1], int(m[2]), m[3]) for m in map(LINE.fullmatch, prompt.split("\n")) if m]


def tell_facts(prompt: str) -> str:
    """A fact for each line with `of the`; facts of one first letter disagree, and each reply cites facts that there aren't."""
    facts = [{"entity": t[:1].lower(), "attribute": "length", "value": str(len(t) % 3), "file": doc, "line": n, "quote": "of the"} for doc, n, t in _lines(prompt) if "of the" in t]
    of: dict[str, list[int]] = {}
    for k, fact in enumerate(facts):
        of.setdefault(fact["entity"], []).append(k)
    against = [{"entity": e, "attribute": "length", "facts": [own[0], own[-1], 10**6], "note": "one of them"} for e, own in sorted(of.items()) if len(own) > 1]
    return json.dumps({"facts": facts, "contradictions": [*against, {"entity": "?", "attribute": "length", "facts": [10**6, -1, 0], "note": "none"}]})


def tell_voices(prompt: str) -> str:
    """A profile of each speaker with the words of the lines shown, and each speaker's longest line as out of voice."""
    lines: dict[str, list[tuple[str, int, str]]] = {}
    for doc, n, text in _lines(prompt):
        name, _, said = text.partition(": ")
        lines.setdefault(name, []).append((doc, n, said))
    characters = [{"name": name, "lines": len(own), "profile": f"{sum(len(x[2].split()) for x in own)} words"} for name, own in lines.items()]
    longest = {name: max(own, key=lambda x: (len(x[2]), x)) for name, own in lines.items()}
    return json.dumps({"characters": characters, "findings": [{"character": name, "file": doc, "line": n, "quote": said[:40], "note": "long"} for name, (doc, n, said) in longest.items()]})


def tell_scenes(prompt: str) -> str:
    """A scene at each heading of the first level; of every other one the end is named too early."""
    found = [{"title": t[2:], "file": doc, "line": n, "last": n + 2 if int(t.split()[-1]) % 2 else None, "opening": t[:30], "goal": "g", "conflict": "c", "change": "d", "verdict": ("keep", "cut", "burn")[n % 3], "note": ""} for doc, n, t in _lines(prompt) if re.fullmatch(r"# Conversation \d+", t)]
    return json.dumps({"scenes": found})


def sources(f: Frames) -> DataFrame:
    return f.docs.select("doc_id", F.col("source").alias("text"))


def paragraph_lines(f: Frames) -> DataFrame:
    """(doc_id, para, line): the line on which each paragraph's first word stands."""
    at = E.word_places(f).select("doc_id", "pos", "line")
    return f.words.select("doc_id", F.col("para").cast("long").alias("para"), F.col("pos").cast("long").alias("pos")).join(at, ["doc_id", "pos"]).groupBy("doc_id", "para").agg(F.min("line").alias("line"))


def queries(documents: Callable[[SparkSession, str], DataFrame], dialogue: Callable[[SparkSession, str], Frames]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ledger = lambda s, d: E.Ledger(documents(s, d), tell_facts, most=MOST)

    def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ledger(spark, sf_dir).contradictions()
        return found.select("batch", "number", "entity", F.element_at("facts", 1).alias("first_fact"), F.element_at("facts", -1).alias("last_fact"), "note")

    def voices(spark: SparkSession, sf_dir: str) -> E.Voices:
        f = dialogue(spark, sf_dir).settled()
        return E.Voices(sources(f), A.attributions(f), paragraph_lines(f), tell_voices)

    def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = dialogue(spark, sf_dir).settled()
        return E.scenes(f, sources(f), tell_scenes, MOST)

    return {
        "facts_ledger": lambda s, d: ledger(s, d).facts(),
        "facts_contradictions": contradictions,
        "facts_conflicts": lambda s, d: ledger(s, d).conflicts(),
        "voice_profiles": lambda s, d: voices(s, d).profiles(),
        "voice_findings": lambda s, d: voices(s, d).findings(),
        "scenes": scenes,
    }


def oracle_sql() -> dict[str, str]:
    ledger = f"""WITH lines AS (SELECT doc_id, k AS line, string_split(text, chr(10))[k] AS t FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(k)),
        placed AS (SELECT *, (sum(strlen(doc_id || ':' || line || '| ' || t) + 1) OVER (ORDER BY doc_id, line) - strlen(doc_id || ':' || line || '| ' || t) - 1)::BIGINT // {MOST // 2} AS batch FROM lines),
        facts AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id, line) - 1 AS fact, lower(t[:1]) AS entity, (length(t) % 3)::VARCHAR AS value FROM placed WHERE contains(t, 'of the'))"""
    return {
        "facts_ledger": f"{ledger} SELECT batch, fact, entity, 'length' AS attribute, value, doc_id, line, strpos(t, 'of the') AS \"column\", true AS verified, 'of the' AS quote FROM facts",
        "facts_contradictions": f"""{ledger} SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY entity) - 1 AS number, entity, min(fact) AS first_fact, max(fact) AS last_fact, 'one of them' AS note FROM facts GROUP BY batch, entity HAVING count(*) > 1""",
        "facts_conflicts": f"""{ledger}, v AS (SELECT trim(regexp_replace(entity, '\\s+', ' ', 'g')) AS entity, value, count(*) AS facts, min({{doc_id: doc_id, line: line}}) AS place FROM facts GROUP BY 1, 2)
            SELECT entity, 'length' AS attribute, value, facts, place.doc_id AS doc_id, place.line AS line FROM v QUALIFY count(*) OVER (PARTITION BY entity) > 1""",
    }
