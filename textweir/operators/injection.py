"""Prompt-injection scoring as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.functions.fixed import HEADERS, LONG_TEXT, NEWLINES, ROLE_MARKERS, RULES, STRICTNESS, WARN_PART, Rule
from textweir.functions.arrays import let
from textweir.functions.regex import js_regex, needed
from textweir.sources.tables import local

VIOLATION = "struct<type:string,scanner:string,score:double,threshold:double,message:string,detail:string>"
NO_VIOLATIONS = f"array<{VIOLATION}>"


def custom_rules(patterns: Sequence[str]) -> tuple[Rule, ...]:
    """User patterns as rules, appended after the built-in ones."""
    return tuple(Rule(f"CUSTOM-{i}", "instruction_override", 0.25, f"Custom pattern #{i}", p) for i, p in enumerate(patterns, 1))


def resolve_threshold(threshold: float | None = None, strictness: str = "medium") -> float:
    """An explicit threshold outranks the strictness."""
    return STRICTNESS.get(strictness, STRICTNESS["medium"]) if threshold is None else threshold


def longer_than(text: Column, units: int) -> Column:
    """Whether a text has more UTF-16 units; the code points alone mostly tell."""
    n = F.length(text)
    return (n > units) | ((n * 2 > units) & (utf16_length(text) > units))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def matches(text: Column, rule: Rule) -> Column:
    return text.rlike(js_regex(rule.pattern, rule.flags))


def has_any(low: Column, words: Sequence[str]) -> Column:
    """Whether a lower-cased text has one of the words; true without words."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) if words else F.lit(True)


def hits(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Whether each rule matches, in rule order (H1): what scores and violations are both made from.
    A pattern is only tried on texts that have a word it needs."""
    return let(F.lower(text), lambda low: F.array(*[has_any(low, needed(r.pattern)) & matches(text, r) for r in rules]))


def signals(text: Column) -> dict[str, Column]:
    """The four structural signals (H4-H7)."""

    def many(pattern: str, flags: str, most: int, score: float, can: Column) -> Column:
        return F.when(can & (F.regexp_count(text, F.lit(js_regex(pattern, flags))) > most), F.lit(score)).otherwise(0.0)

    _, _, most, score = NEWLINES
    lines = F.when(F.length(text) - F.length(F.replace(text, F.lit("\n"))) > most, F.lit(score)).otherwise(0.0)
    headers = many(*HEADERS, F.contains(text, F.lit("#")))
    markers = many(*ROLE_MARKERS, has_any(F.lower(text), needed(ROLE_MARKERS[0])))
    long = F.when(longer_than(text, LONG_TEXT[0]), F.lit(LONG_TEXT[1])).otherwise(0.0)
    return {"newlines": lines, "headers": headers, "role_markers": markers, "long_text": long}


def structural_score(text: Column) -> Column:
    return reduce(lambda a, b: a + b, signals(text).values(), F.lit(0.0))


def score_of(hit: Column, structure: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Weights of matching rules, summed in rule order, plus structure, at most 1 (H2, H8)."""
    weights = F.zip_with(hit, F.array(*[F.lit(r.weight) for r in rules]), lambda h, w: F.when(h, w).otherwise(0.0))
    return F.least(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) + structure, F.lit(1.0))


def total_score(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Score of a text; a null text has none."""
    return F.when(text.isNotNull(), score_of(hits(text, rules), structural_score(text), rules))


def decide(score: Column, threshold: float | Column) -> Column:
    """block from the threshold, warn from 0.6 of it, else allow (H9)."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= limit, "block").when(score >= limit * WARN_PART, "warn").when(score.isNotNull(), "allow")


def violations(hit: Column, threshold: float | Column, rules: Sequence[Rule] = RULES) -> Column:
    """One violation for each matching rule of hits(), in rule order (H3)."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    known = F.array(*[F.struct(F.lit(r.weight).alias("score"), F.lit(r.description).alias("message"), F.lit(f"Rule {r.id} ({r.category})").alias("detail")) for r in rules])

    def made(h: Column, r: Column) -> Column:
        kind, scanner = F.lit("prompt_injection").alias("type"), F.lit("heuristic").alias("scanner")
        return F.when(h, F.struct(kind, scanner, r["score"].alias("score"), limit.alias("threshold"), r["message"].alias("message"), r["detail"].alias("detail")))

    return F.array_compact(F.zip_with(hit, known, made)).cast(NO_VIOLATIONS)


def rule_hits(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Ids and categories of matching rules, for rollups."""
    names = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category")) for r in rules])
    return F.array_compact(F.zip_with(hits(text, rules), names, lambda h, n: F.when(h, n)))


def rule_catalog(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rules as a table."""
    return local(spark, [(i, r.id, r.category, r.weight, r.description) for i, r in enumerate(rules)], "ord int, rule_id string, category string, weight double, description string")
