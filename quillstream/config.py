"""Settings from a TOML text: every key is checked, lists extend the built-in ones, thresholds become a limits table."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import get_type_hints

from .functions import fixed_values as V


@dataclass(frozen=True)
class Project:
    files: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Echoes:
    window: int = 50
    min_length: int = 4
    include_names: bool = False
    ignore: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Repeats:
    min: int = 3
    max: int = 6
    count: int = 2


@dataclass(frozen=True)
class Rhythm:
    run: int = 4
    tolerance: int = 3
    long: int = 40


@dataclass(frozen=True)
class Starters:
    run: int = 3


@dataclass(frozen=True)
class Tics:
    words: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Continuity:
    ignore: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Lexicon:
    stopwords: list[str] = field(default_factory=list)
    filter: list[str] = field(default_factory=list)
    hedges: list[str] = field(default_factory=list)
    cliches: list[str] = field(default_factory=list)
    not_adverbs: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    files: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Check:
    """Thresholds by metric, for example `max_adverbs_per_1k = 8.0` or `min_mattr = 0.7`, and severities by metric."""

    limits: dict[str, float] = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    project: Project = Project()
    echoes: Echoes = Echoes()
    repeats: Repeats = Repeats()
    rhythm: Rhythm = Rhythm()
    starters: Starters = Starters()
    tics: Tics = Tics()
    continuity: Continuity = Continuity()
    lexicon: Lexicon = Lexicon()
    check: Check = Check()

    def limits_rows(self) -> list[tuple[str, str, float, str]]:
        """(rule, kind, limit, severity) of the thresholds; a rule without a severity is an error."""
        split = [(*k.split("_", 1), v) for k, v in self.check.limits.items()]
        return [(METRIC_OF.get(rule, rule), kind, float(v), self.check.severity.get(rule.removesuffix("_per_1k"), "error")) for kind, rule, v in split]

    def lists(self, listed: dict[str, list[str]] | None = None) -> dict[str, tuple[str, ...]]:
        """All word lists: built-in entries, those of the settings and of list files (`listed`, by list), less the ignored ones."""
        mine, listed = self.lexicon, listed or {}
        if unknown := set(listed) - set(LISTS):
            raise ValueError(f"unknown list {min(unknown)}")
        own = {"stopwords": mine.stopwords, "not_adverbs": [*mine.not_adverbs, *mine.ignore], "filter": mine.filter, "hedges": mine.hedges, "cliches": mine.cliches, "tics": self.tics.words}
        out = {}
        for name, base in LISTS.items():
            entries = dict.fromkeys(e.strip().lower() for e in (*base, *own[name], *listed.get(name, ())))
            gone = {e.lower() for e in mine.ignore} if name in ("filter", "hedges", "cliches", "tics") else set()
            out[name] = tuple(e for e in entries if e and e not in gone)
        return out


LISTS = {"stopwords": V.STOPWORDS, "not_adverbs": V.NOT_ADVERBS, "filter": V.FILTER_WORDS, "hedges": V.HEDGES, "cliches": V.CLICHES, "tics": ()}
#: Metrics whose column has another name than the threshold.
METRIC_OF = {"grade": "flesch_kincaid_grade"}
# The thresholds a settings file may name.
THRESHOLDS = (
    "max_echoes_per_1k", "max_adverbs_per_1k", "max_filter_per_1k", "max_hedges_per_1k", "max_tics_per_1k", "max_passive_per_1k", "max_nominal_per_1k",
    "max_overused", "max_cliches", "max_repeated_starter_runs", "max_monotonous_runs", "max_sentence_words", "min_mattr", "max_grade", "min_dialogue_ratio", "max_dialogue_ratio",
)


def _build(kind: type, values: dict, where: str):
    hints = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    for key, value in values.items():
        if key not in known:
            raise ValueError(f"unknown setting {where}{key}")
        wanted = getattr(hints[key], "__origin__", hints[key])
        if not is_dataclass(hints[key]) and (not isinstance(value, wanted) or (wanted is int and isinstance(value, bool))):
            raise ValueError(f"{where}{key} must be of type {wanted.__name__}")
    return kind(**{k: _build(hints[k], v, f"{where}{k}.") if is_dataclass(hints[k]) else v for k, v in values.items()})


def from_toml(text: str) -> Config:
    """Settings of a TOML text; an unknown section or key, a wrong type or an unknown severity is an error."""
    raw = tomllib.loads(text)
    check = dict(raw.pop("check", {}))
    severity = check.pop("severity", {})
    if unknown := set(check) - set(THRESHOLDS):
        raise ValueError(f"unknown setting check.{min(unknown)}")
    if bad := set(severity.values()) - {"error", "warn"}:
        raise ValueError(f"unknown severity {min(bad)}")
    return _build(Config, {**raw, "check": {"limits": check, "severity": severity}}, "")


PRESETS = {
    "fiction": '[echoes]\nwindow = 50\n\n[check]\nmax_adverbs_per_1k = 12.0\nmax_passive_per_1k = 8.0\n',
    "essay": '[check]\nmax_hedges_per_1k = 10.0\nmax_grade = 14.0\n',
    "screenplay": '[check]\nmin_dialogue_ratio = 0.3\n',
}
