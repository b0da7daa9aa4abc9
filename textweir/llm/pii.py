"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them and words before them adjust the
score. The patterns are written so that Java's matcher neither recurses over repeated groups
nor retries a run of characters from each of its positions: a text is first rewritten, character
by character and at equal length, so that single character classes suffice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions.arrays import blocks, cut, let, matches, running
from textweir.functions.names import fresh

#: Kinds that the contract fixes, in its order, and those that this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Code points before a span in which context words count, and matches before it that hold as many:
#: none has fewer than two, nor has the text between two.
CONTEXT, BEFORE = 40, 20
#: Stands for a dot in a local part, and for itself where a text has it.
DOT, OTHER = "\ue000", "\ue001"
SPAN = "array<struct<start:int,end:int,value:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    name: str
    #: Cheap test that holds for every text with a match.
    hint: Callable[[Column], Column]
    #: Equal-length rewriting after which `pattern` finds the spans.
    rewrite: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    context: str
    score: float
    #: Least score that keeps a span; a context word adds BONUS.
    least: float = 0.0


BONUS = 0.3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(number)
    digit = lambda i: F.substring(number, i, F.lit(1)).cast("int")
    doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, doubled(i)).otherwise(digit(i)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Remainder by 97 of an IBAN moved by four characters, letters counting from 10."""
    plain = F.upper(F.regexp_replace(value, "[ -]", ""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, F.lit(1), F.lit(4)))
    number = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(moved, i, F.lit(1))) - 1
    codes = F.transform(F.sequence(F.lit(1), F.length(moved)), number)
    return F.aggregate(codes, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def small_parts(value: Column) -> Column:
    """Whether each dotted part is at most 255, however many zeros lead it."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).cast("int") <= 255))


def between(value: Column, low: int, high: int) -> Column:
    return F.length(digits(value)).between(low, high)


ALL = (
    Kind(
        "email",
        lambda t: F.contains(t, F.lit("@")),
        # A dot that no domain can hold becomes another character of the local part.
        lambda t: F.regexp_replace(F.translate(t, DOT, OTHER), r"\.(?![A-Za-z0-9-])", DOT),
        rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@(?=[A-Za-z0-9-]++\.)[A-Za-z0-9.-]++",
        lambda v: F.lit(True),
        r"(?i)mail|contact|write",
        0.7,
    ),
    Kind(
        "ip",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        lambda t: t,
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        small_parts,
        r"(?i)\bip\b|address|host|server",
        0.6,
    ),
    Kind(
        "card",
        lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
        # Separators that do not stand between two digits cannot be part of a number.
        lambda t: F.regexp_replace(t, r"(?<![0-9])[ -]|[ -](?![0-9])", "\u0001"),
        r"[0-9][0-9 -]++",
        lambda v: between(v, 16, 19) & luhn(digits(v)),
        r"(?i)card|visa|credit|payment",
        0.7,
    ),
    Kind(
        "phone",
        lambda t: t.rlike(r"\+[0-9]"),
        lambda t: t,
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: between(v, 8, 15),
        r"(?i)tel|phone|call|fax",
        0.6,
    ),
    Kind(
        "iban",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ -]?[0-9A-Z]{4}"),
        lambda t: t,
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[0-9A-Z]{4}){2,7}(?:[ -]?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
        lambda v: F.length(F.regexp_replace(v, "[ -]", "")).between(15, 34) & (mod97(v) == 1),
        r"(?i)iban|account|bank",
        0.8,
        0.5,
    ),
    Kind(
        "ssn",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda t: t,
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda v: F.lit(True),
        r"(?i)\bssn\b|social security",
        0.3,
        0.5,
    ),
)


def spans_of(kind: Kind, text: Column) -> Column:
    """Confirmed and scored spans of one kind."""

    def scored(found: Column) -> Column:
        def of(tails: Column) -> Column:
            numbered = F.transform(found, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["gap"].alias("gap"), F.translate(m["value"], DOT, ".").alias("value"), i.alias("i")))

            def made(m: Column) -> Column:
                first = F.greatest(m["i"] - BEFORE, F.lit(0))
                before = F.right(F.concat(F.array_join(F.slice(tails, first + 1, m["i"] - first), ""), m["gap"]), F.lit(CONTEXT))
                score = F.lit(kind.score) + F.when(before.rlike(kind.context), BONUS).otherwise(0.0)
                return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

            return F.transform(F.filter(numbered, lambda m: kind.valid(m["value"])), made)

        tail = lambda m: F.concat(F.right(m["gap"], F.lit(CONTEXT)), F.right(m["value"], F.lit(CONTEXT)))
        return let(F.transform(found, tail), of)

    kept = F.filter(let(matches(kind.rewrite(text), kind.pattern), scored), lambda m: m["score"] >= kind.least)
    return F.when(kind.hint(text), kept).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a column `pii`, a struct with the spans of each kind from left to right.

    Spans are (start, end, value, score) in code points, the end exclusive. A null text counts
    as empty and has no spans; equal rows are treated alike; an empty table stays empty. An input
    column called `pii` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.struct(*[spans_of(k, text).alias(k.name) for k in ALL]))


def listed(kinds: tuple[str, ...], spans: Column) -> Column:
    """kind:start:end of all spans, by kind, comma-joined."""

    def named(kind: str) -> Column:
        place = lambda m: F.concat(F.lit(f"{kind}:"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))
        return F.transform(spans[kind], place)

    return F.array_join(F.concat(*map(named, kinds)), ",")


def scores(kinds: tuple[str, ...], spans: Column) -> Column:
    """Scores of all spans in the order of listed(), comma-joined."""
    return F.array_join(F.concat(*[F.transform(spans[kind], lambda m: F.format_string("%.1f", m["score"])) for kind in kinds]), ",")


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span found by find_pii() with its kind in brackets, such as [EMAIL].

    Spans of different kinds that overlap are merged and take the name of the first; a null text
    stays null. Columns stay as they are otherwise, whatever their names; equal rows are treated
    alike; an empty table stays empty.
    """
    text = F.col(text_col)
    (helper,) = fresh(docs, "_spans")
    plain = F.coalesce(text, F.lit(""))

    def named(kind: Kind) -> Column:
        label = F.lit(f"[{kind.name.upper()}]").alias("kind")
        return F.transform(spans_of(kind, plain), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), label))

    def spliced(spans: Column, parts: Column, upto: Column) -> Column:
        # Beside each span, where the ones before it end; behind the last, where all end.
        pairs = F.zip_with(spans, F.concat(F.array(F.lit(0)), upto), lambda m, end: F.struct(m.alias("m"), end.alias("end")))
        begins = F.filter(pairs, lambda p: p["m"].isNull() | (p["m"]["start"] >= p["end"]))
        rest = lambda p: F.coalesce(p["m"]["start"] - p["end"], F.lit(1 << 30))
        return F.array_join(F.transform(begins, lambda p: F.concat(cut(parts, p["end"], rest(p)), F.coalesce(p["m"]["kind"], F.lit("")))), "")

    ends = running(F.transform(helper, lambda m: m["end"]), lambda a, b: F.greatest(a, b))
    masked = let(ends, lambda upto: let(blocks(text), lambda parts: spliced(F.col(helper), parts, upto)))
    spans = F.sort_array(F.concat(*map(named, ALL)))
    # A generator binds the spans, so that they are found once.
    found = docs.select("*", F.explode(F.array(spans)).alias(helper))
    return found.withColumn(text_col, F.when(F.size(helper) > 0, masked).otherwise(text)).drop(helper)
