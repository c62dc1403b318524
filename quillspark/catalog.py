"""The rule catalog: read, validated, and as tables.

Rules are data (``data/rules.toml``); no pattern is written in the engine.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

CATEGORIES = ("paste_residue", "quality_patterns", "injection_patterns")
CLASSES = ("spike", "background", "individual")
MECHANISMS = (
    "word-set", "regex", "codepoint", "positional-space", "participial-opener", "contrastive-tail", "self-duplication",
)


class CatalogError(ValueError):
    """The catalog breaks one of its own rules."""


@dataclass(frozen=True)
class Rule:
    """One validated rule; fields that its mechanism does not use hold their defaults."""

    id: str
    name: str
    category: str
    mechanism: str
    cls: str | None = None
    case: str = "sensitive"
    boundary: str = "none"
    position: str = "anywhere"
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exemptions: tuple[str, ...] = ()
    stoplist: frozenset[str] = frozenset()
    second_person: tuple[str, ...] = ()
    ranges: tuple[tuple[int, int], ...] = ()
    codepoints: tuple[int, ...] = ()
    min_count: int = 1
    exempt_leading_bom: bool = False
    exempt_presentation_selector: bool = False
    exempt_joining_zwj: bool = False
    max_clause: int = 100
    max_np: int = 60
    clause_window: int = 240
    shingle_words: int = 0
    min_run_words: int = 0
    max_reports: int = 0
    edges: tuple[tuple[bool, bool], ...] = field(default=(), compare=False)


#: Which mechanisms may have a field; a field of the left may not stand elsewhere.
_ONLY = {
    "terms": {"word-set"},
    "exemptions": {"word-set"},
    "case": {"word-set"},
    "boundary": {"word-set"},
    "position": {"word-set"},
    "patterns": {"word-set", "regex", "contrastive-tail"},
    "stoplist": {"participial-opener", "contrastive-tail"},
    "second_person": {"contrastive-tail"},
    "max_np": {"contrastive-tail"},
    "clause_window": {"contrastive-tail"},
    "max_clause": {"participial-opener"},
    "ranges": {"codepoint"},
    "exempt_leading_bom": {"codepoint"},
    "exempt_presentation_selector": {"codepoint"},
    "exempt_joining_zwj": {"codepoint"},
    "codepoints": {"positional-space"},
    "min_count": {"positional-space"},
    "shingle_words": {"self-duplication"},
    "min_run_words": {"self-duplication"},
    "max_reports": {"self-duplication"},
}
#: What a mechanism cannot do without.
_NEEDS = {
    "word-set": ("terms",),
    "regex": ("patterns",),
    "codepoint": ("ranges",),
    "positional-space": ("codepoints",),
    "participial-opener": ("stoplist",),
    "contrastive-tail": ("stoplist",),
    "self-duplication": ("shingle_words", "min_run_words", "max_reports"),
}
_CHOICES = {
    "category": CATEGORIES, "class": CLASSES, "mechanism": MECHANISMS, "case": ("sensitive", "insensitive"),
    "boundary": ("none", "word"), "position": ("anywhere", "block-start"),
}


def scalar(text: str) -> int:
    """A hexadecimal Unicode scalar value."""
    try:
        v = int(text, 16)
    except ValueError:
        raise CatalogError(f"not a code point: {text}") from None
    if not 0 <= v <= 0x10FFFF or 0xD800 <= v <= 0xDFFF:
        raise CatalogError(f"not a Unicode scalar: {text}")
    return v


def code_range(text: str) -> tuple[int, int]:
    """``A-B`` or ``A``, inclusive."""
    lo, _, hi = text.partition("-")
    a, b = scalar(lo), scalar(hi or lo)
    if a > b:
        raise CatalogError(f"inverted range: {text}")
    return a, b


def check_pattern(pattern: str) -> tuple[bool, bool]:
    r"""Reject what the engine does not do; return whether the edges are ``\b``.

    No look-around, bounded width only, no empty match.
    """
    if re.search(r"\(\?(?:<|!|=)", pattern):
        raise CatalogError(f"look-around in {pattern}")
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    if re.search(r"[*+]|\{\d*,\}", bare):
        raise CatalogError(f"unbounded width in {pattern}")
    try:
        compiled = re.compile(pattern, re.M)
    except re.error as e:
        raise CatalogError(f"{pattern}: {e}") from None
    if compiled.match(""):
        raise CatalogError(f"{pattern} can match nothing")
    return pattern.removeprefix("(?i)").startswith(r"\b"), pattern.endswith(r"\b")


def make_rule(id_: str, raw: dict) -> Rule:
    """One rule from its raw fields, or :class:`CatalogError`."""
    known = {"name", "category", "class", "mechanism", *_ONLY}
    if unknown := raw.keys() - known:
        raise CatalogError(f"{id_}: unknown fields {sorted(unknown)}")
    for key in ("name", "category", "mechanism"):
        if key not in raw:
            raise CatalogError(f"{id_}: no {key}")
    for key, choices in _CHOICES.items():
        if key in raw and raw[key] not in choices:
            raise CatalogError(f"{id_}: {key} {raw[key]!r}")
    mechanism = raw["mechanism"]
    if (raw["category"] == "quality_patterns") != ("class" in raw):
        raise CatalogError(f"{id_}: quality patterns, and only they, have a class")
    for key, where in _ONLY.items():
        if key in raw and mechanism not in where:
            raise CatalogError(f"{id_}: {key} is not for {mechanism}")
    for key in _NEEDS[mechanism]:
        if not raw.get(key):
            raise CatalogError(f"{id_}: {mechanism} needs {key}")
    if mechanism == "self-duplication" and raw["min_run_words"] < raw["shingle_words"]:
        raise CatalogError(f"{id_}: a run is shorter than a shingle")
    terms = tuple(t.strip() for t in raw.get("terms", ()))
    if not all(terms):
        raise CatalogError(f"{id_}: an empty term")
    exemptions = tuple(x.lower() for x in raw.get("exemptions", ()))
    if any(not x or not x[0].isascii() for x in exemptions):
        raise CatalogError(f"{id_}: an exemption must begin with an ASCII character")
    patterns = tuple(raw.get("patterns", ()))
    return Rule(
        id=id_, name=raw["name"], category=raw["category"], mechanism=mechanism, cls=raw.get("class"),
        case=raw.get("case", "sensitive"), boundary=raw.get("boundary", "none"), position=raw.get("position", "anywhere"),
        terms=terms, patterns=patterns, exemptions=exemptions,
        stoplist=frozenset(_ascii_lower(w) for w in raw.get("stoplist", ())),
        second_person=tuple(raw.get("second_person", ())),
        ranges=tuple(code_range(r) for r in raw.get("ranges", ())),
        codepoints=tuple(scalar(c) for c in raw.get("codepoints", ())),
        edges=tuple(check_pattern(p) for p in patterns),
        **{k: raw[k] for k in (
            "min_count", "exempt_leading_bom", "exempt_presentation_selector", "exempt_joining_zwj", "max_clause",
            "max_np", "clause_window", "shingle_words", "min_run_words", "max_reports",
        ) if k in raw},
    )


def _ascii_lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def parse_rules(text: str) -> tuple[Rule, ...]:
    """The rules of a catalog's text, in order; a repeated id or an empty table is an error."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:  # a repeated id is one of these
        raise CatalogError(str(e)) from None
    if not raw:
        raise CatalogError("no rules")
    return tuple(make_rule(i, r) for i, r in raw.items())


@lru_cache(maxsize=1)
def load_rules() -> tuple[Rule, ...]:
    """The shipped catalog."""
    return parse_rules(resources.files("quillspark").joinpath("data/rules.toml").read_text("utf-8"))


def rules_table(spark: SparkSession) -> DataFrame:
    """One row a rule: its id, name, category, class, mechanism and parameters."""
    return spark.createDataFrame(
        [
            (r.id, r.name, r.category, r.cls, r.mechanism, r.case, r.boundary, r.position, r.min_count, r.max_clause,
             r.max_np, r.clause_window, r.shingle_words, r.min_run_words, r.max_reports)
            for r in load_rules()
        ],
        "rule_id string, name string, category string, class string, mechanism string, case string, boundary string,"
        " position string, min_count int, max_clause int, max_np int, clause_window int, shingle_words int,"
        " min_run_words int, max_reports int",
    )


def terms_table(spark: SparkSession) -> DataFrame:
    """``(rule_id, term)`` of the word-set rules."""
    return spark.createDataFrame([(r.id, t) for r in load_rules() for t in r.terms], "rule_id string, term string")


def patterns_table(spark: SparkSession) -> DataFrame:
    """``(rule_id, pattern_idx, pattern, bound_start, bound_end)``."""
    rows = [(r.id, k, p, *e) for r in load_rules() for k, (p, e) in enumerate(zip(r.patterns, r.edges))]
    return spark.createDataFrame(
        rows, "rule_id string, pattern_idx int, pattern string, bound_start boolean, bound_end boolean"
    )
