"""Detection, validation, overlap resolution and masking of personal data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweir.functions.arrays import blocks as text_blocks
from textweir.functions.arrays import cut, in_chunks, let, matches
from textweir.functions.fixed import PII_PATTERNS
from textweir.functions.regex import SPACE, js_regex

from .injection import NO_VIOLATIONS

ENTITY = "struct<type:string,value:string,start:int,end:int,confidence:double>"
#: Cheap tests that hold for every text with a match of the type.
HINTS = {
    "iban": r"[A-Z]{2}[^a-zA-Z]{20}",
    "credit_card": r"[0-9]{4}[^a-zA-Z0-9]?[0-9]{4}[^a-zA-Z0-9]?[0-9]{4}",
    "german_tax_id": r"[0-9]{2}[^a-zA-Z0-9]?[0-9]{3}[^a-zA-Z0-9]?[0-9]{3}",
    "german_social_security": r"[0-9]{6}[^a-zA-Z0-9]?[A-Z]",
    "email": "@",
    "phone": f"[+0][0-9(/{SPACE}-]",
    "ip_address": r"[0-9]\.[0-9]{1,3}\.[0-9]",
    "url_with_credentials": r"https?://",
}


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def cleaned(value: Column) -> Column:
    """What validators see: no white space and no hyphens."""
    return F.regexp_replace(value, f"[{SPACE}-]", "")


def characters(value: Column, code) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: code(F.substring(value, i, F.lit(1)), i))


def valid_iban(value: Column) -> Column:
    """Length and remainder 1 modulo 97 after four characters move to the end (P10)."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substring(value, F.lit(1), F.lit(4)))
    code = lambda c, _: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.cast("int"))
    rest = F.aggregate(characters(moved, code), F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return F.length(value).between(15, 34) & (rest == 1)


def valid_card(value: Column) -> Column:
    """Luhn's sum over 13 to 19 digits."""
    digits = F.reverse(digits_of(value))

    def code(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.length(digits).between(13, 19) & (F.aggregate(characters(digits, code), F.lit(0), lambda a, d: a + d) % 10 == 0)


def valid_tax_id(value: Column) -> Column:
    return value.rlike("^[1-9][0-9]{10}$")


def valid_phone(value: Column) -> Column:
    return F.length(digits_of(value)).between(7, 15)


def public_ip(value: Column) -> Column:
    """Not in a private or loopback range."""
    part = lambda i: F.split(value, r"\.")[i].cast("int")
    private = (part(0) == 10) | ((part(0) == 172) & part(1).between(16, 31)) | ((part(0) == 192) & (part(1) == 168)) | (part(0) == 127)
    return ~private


VALID = {"iban": valid_iban, "credit_card": valid_card, "german_tax_id": valid_tax_id, "phone": valid_phone, "ip_address": public_ip}


def detect_type(text: Column, pii_type: str) -> Column:
    """All valid entities of one type from left to right, before overlaps are resolved.

    Matches that fail their validator still consume text.
    """
    ord_, (_, source, confidence) = next((i, p) for i, p in enumerate(PII_PATTERNS) if p.type == pii_type)

    def entity(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), (m["start"] - m["end"]).alias("minus"), F.lit(ord_).alias("ord"), F.lit(pii_type).alias("type"), m["value"].alias("value"), m["end"].alias("end"), F.lit(confidence).alias("confidence"))

    kind = "array<struct<start:int,minus:int,ord:int,type:string,value:string,end:int,confidence:double>>"
    found = matches(text, js_regex(source))
    if pii_type in VALID:
        found = F.filter(found, lambda m: VALID[pii_type](cleaned(m["value"])))
    return F.when(text.rlike(HINTS[pii_type]), F.transform(found, entity)).otherwise(F.array().cast(kind))


def values_of(text: Column, pii_type: str) -> Column:
    """The values of detect_type() alone; their places, which cost more, are not sought."""
    source = next(p.pattern for p in PII_PATTERNS if p.type == pii_type)
    found = F.regexp_extract_all(text, F.lit(js_regex(source)), F.lit(0))
    if pii_type in VALID:
        found = F.filter(found, lambda v: VALID[pii_type](cleaned(v)))
    return F.when(text.rlike(HINTS[pii_type]), found).otherwise(F.array().cast("array<string>"))


def detect(text: Column) -> Column:
    """Entities without overlaps: by start, longer first, then pattern order; greedy.

    Kept entities never overlap, so the end of the last one decides.
    """
    everything = F.sort_array(F.concat(*[detect_type(text, p.type) for p in PII_PATTERNS]))

    def entity(e: Column) -> Column:
        return F.struct(*[e[c].alias(c) for c in ("type", "value", "start", "end", "confidence")])

    def step(a: Column, e: Column) -> Column:
        free = e["start"] >= a["last"]
        return F.struct(F.when(free, e["end"]).otherwise(a["last"]).alias("last"), F.when(free, F.concat(a["kept"], F.array(entity(e)))).otherwise(a["kept"]).alias("kept"))

    def chosen(found: Column) -> Column:
        meets = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False)))
        return F.when(F.exists(meets, lambda m: m), in_chunks(found, F.lit(0), step, ENTITY)).otherwise(F.transform(found, entity))

    return let(everything, chosen)


def active(entities: Column, allowed_types: Iterable[str] = ()) -> Column:
    """Allowed types go after overlaps are resolved, so they still suppress others."""
    names = list(allowed_types)
    return F.filter(entities, lambda e: ~e["type"].isin(names)) if names else entities


def action_of(pii_type: Column, default: str, types: Mapping[str, str]) -> Column:
    out = F.lit(default)
    for name, action in types.items():
        out = F.when(pii_type == name, action).otherwise(out)
    return out


def violations(entities: Column, default: str = "mask", types: Mapping[str, str] | None = None) -> Column:
    """One violation for each entity, with its place and action."""

    def made(e: Column) -> Column:
        action = action_of(e["type"], default, types or {})
        return F.struct(
            F.lit("pii_detected").alias("type"),
            F.lit("pii").alias("scanner"),
            e["confidence"].alias("score"),
            F.lit(0.0).alias("threshold"),
            F.concat(e["type"], F.lit(" detected")).alias("message"),
            F.format_string("Found %s at position %d-%d (action: %s)", e["type"], e["start"], e["end"], action).alias("detail"),
        )

    return F.transform(entities, made).cast(NO_VIOLATIONS)


def blocks(entities: Column, default: str, types: Mapping[str, str]) -> Column:
    return F.exists(entities, lambda e: action_of(e["type"], default, types) == "block")


def decide(entities: Column, default: str = "mask", types: Mapping[str, str] | None = None) -> Column:
    """allow without entities, block if any action blocks, else warn."""
    return F.when(F.size(entities) == 0, "allow").when(blocks(entities, default, types or {}), "block").when(entities.isNotNull(), "warn")


def masked_value(entity: Column) -> Column:
    """Replacement of one entity."""
    value, at = entity["value"], F.instr(entity["value"], "@")
    email = F.when(at <= 2, "[EMAIL]").otherwise(F.concat(F.substring(value, F.lit(1), F.lit(1)), F.lit("***@"), F.substr(value, at + 1)))
    phone = F.concat(F.substring(value, F.lit(1), F.lit(4)), F.lit("****"), F.substr(value, F.greatest(F.length(value) - 1, F.lit(1))))
    iban = F.concat(F.substring(value, F.lit(1), F.lit(4)), F.lit(" **** **** ****"))
    card = F.concat(F.lit("**** **** **** "), F.substr(digits_of(value), F.lit(13)))
    kind = entity["type"]
    other = F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "credit_card", card).otherwise(other)


def mask(text: Column, entities: Column) -> Column:
    """Text with every entity replaced; entities are in order and disjoint."""

    def spliced(found: Column) -> Column:
        after = F.concat(F.array(F.lit(0)), F.transform(found, lambda e: e["end"]))

        def joined(parts: Column) -> Column:
            piece = lambda at, e: F.concat(cut(parts, at, F.when(e.isNull(), F.lit(1 << 30)).otherwise(e["start"] - at)), F.when(e.isNull(), "").otherwise(masked_value(e)))
            return F.array_join(F.zip_with(after, found, piece), "")

        return let(text_blocks(text), joined)

    return F.when(F.size(entities) == 0, text).otherwise(let(entities, spliced))


def sanitize(text: Column, entities: Column, default: str = "mask", types: Mapping[str, str] | None = None) -> Column:
    """Masked text if nothing blocks and the default action masks, else the text as it is (P20)."""
    if default not in ("mask", "tokenize"):
        return text
    return F.when(blocks(entities, default, types or {}), text).otherwise(mask(text, entities))
