import re

import pytest
from pyspark.sql import functions as F

from textweir.functions.fixed import PII_PATTERNS
from textweir.operators import pii
from textweir.operators.chain import ScanConfig, scan
from textweir.plans.catalog import PROBES

TEXTS = [*PROBES, "", "4111 1111 1111 1111 0170 4111 1111 1111 1111", "éa@b.org +49 30 12345678 and", "x@y.co 8.8.8.8 DE89 3704 0044 0532 0130 00", "https://u:p@h.org/a a@b.cd", None]


def luhn(value):
    digits = [int(c) for c in re.sub(r"\D", "", value)][::-1]
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def iban(value):
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def public(value):
    a, b, *_ = map(int, value.split("."))
    return not (a in (10, 127) or a == 172 and 16 <= b <= 31 or a == 192 and b == 168)


VALID = {"iban": iban, "credit_card": luhn, "german_tax_id": lambda v: len(v) == 11 and v[0] != "0", "phone": lambda v: 7 <= len(re.sub(r"\D", "", v)) <= 15, "ip_address": public}


def brute(text):
    found = []
    for ord_, p in enumerate(PII_PATTERNS):
        for m in re.finditer(p.pattern, text or "", re.ASCII):
            if p.type not in VALID or VALID[p.type](re.sub(r"[\s-]", "", m.group())):
                found.append((m.start(), -len(m.group()), ord_, p.type, m.group(), m.end()))
    kept, last = [], 0
    for start, _, _, kind, value, end in sorted(found):
        if start >= last:
            kept.append((kind, value, start, end))
            last = end
    return kept


def test_entities_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for row in df.select("i", "t", pii.detect(F.col("t")).alias("e")).collect():
        got = [(e.type, e.value, e.start, e.end) for e in row.e or []]
        assert got == brute(row.t)
        assert all(row.t[e.start : e.end] == e.value for e in row.e or [])


def test_places_in_tables(spark):
    """The registered queries agree with brute force on a given table."""
    from textweir.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in catalog.documents(spark, sf).collect()}
    got = {}
    for r in catalog.pii_entities(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.pii_type, r.value, r.start, r.end))
    for doc, text in texts.items():
        assert sorted(got.get(doc, []), key=lambda e: e[2]) == brute(text)


@pytest.mark.parametrize(
    "kind,value,expected",
    [
        ("email", "jane@x.org", "j***@x.org"),
        ("email", "j@x.org", "[EMAIL]"),
        ("phone", "+49 30 1234567", "+49 ****67"),
        ("iban", "DE89 3704 0044 0532 0130 00", "DE89 **** **** ****"),
        ("credit_card", "4111-1111-1111-1234", "**** **** **** 1234"),
        ("ip_address", "8.8.8.8", "[IP_ADDRESS]"),
    ],
)
def test_masks(spark, kind, value, expected):
    df = spark.createDataFrame([((kind, value),)], "e struct<type:string,value:string>")
    assert df.select(pii.masked_value(F.col("e"))).head()[0] == expected


@pytest.mark.parametrize(
    "config,decision,masked",
    [
        (ScanConfig(), "warn", True),
        (ScanConfig(pii_types={"email": "allow"}), "warn", True),
        (ScanConfig(pii_types={"email": "block"}), "block", False),
        (ScanConfig(pii_action="allow"), "warn", False),
        (ScanConfig(pii_action="block"), "block", False),
        (ScanConfig(pii_action="block", pii_types={"email": "allow"}), "warn", False),
        (ScanConfig(pii_action="tokenize"), "warn", True),
        (ScanConfig(allowed_types=("email",)), "allow", False),
    ],
)
def test_actions(spark, config, decision, masked):
    row = scan(spark.createDataFrame([("to jane@x.org now",)], "text string"), config=config).head()
    assert row.decision == decision
    assert row.sanitized == ("to j***@x.org now" if masked else "to jane@x.org now")


def test_allowed_type_still_suppresses(spark):
    text = "https://u:pw@h.org"
    row = scan(spark.createDataFrame([(text,)], "text string"), config=ScanConfig(allowed_types=("url_with_credentials",))).head()
    assert row.decision == "allow" and row.sanitized == text


def test_masking_twice_changes_nothing_more(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    once = scan(df).select(F.col("sanitized").alias("text"))
    emails = scan(once).select(F.exists("violations", lambda v: v["message"] == "credit_card detected").alias("again"))
    assert not any(r.again for r in emails.collect())


def test_hints_hold_wherever_patterns_match(spark):
    """Random texts around each pattern, with white space of all kinds: a hint never hides a match."""
    import random

    rng = random.Random(6)
    parts = ["0", "+", "49", "171", "5554443", "1234567", "\t", "\n", " ", " ", " ", "-", "/", "(", ")", "DE89", "3704", "0044", "0532", "0130", "00", "4111", "1111", "12", "345", "678", "901", "345678", "A", "123", "a@b", ".org", "8.8.", "8.8", "https://", "u:p@", "h"]
    texts = ["0\t31 1234567", "0\n171/5554443", "0 171 5554443", *("".join(rng.choice(parts) for _ in range(rng.randint(3, 14))) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)

    def hidden(p):
        valid = (lambda v: pii.VALID[p.type](pii.cleaned(v))) if p.type in pii.VALID else (lambda v: F.lit(True))
        return F.size(F.filter(F.regexp_extract_all("t", F.lit(pii.js_regex(p.pattern)), F.lit(0)), valid)) != F.size(pii.detect_type(F.col("t"), p.type))

    assert df.where(F.greatest(*map(hidden, PII_PATTERNS))).count() == 0
    assert [r.n for r in df.where("i < 3").select(F.size(pii.detect_type(F.col("t"), "phone")).alias("n")).collect()] == [1, 1, 1]


def test_many_spans_in_linear_time(spark):
    """100,000 e-mails in a text are found and masked in seconds."""
    import time

    df = spark.createDataFrame([("a@b.cd, " * 100_000,), ("x " * 5000 + "jane@b.cd " + "é" * 9000,), ("",)], "t string")
    began = time.time()
    rows = df.select(F.size(pii.detect(F.col("t"))).alias("n"), pii.sanitize(F.col("t"), pii.detect(F.col("t"))).alias("s")).collect()
    assert [r.n for r in rows] == [100_000, 1, 0] and rows[0].s == "[EMAIL], " * 100_000
    assert rows[1].s == "x " * 5000 + "j***@b.cd " + "é" * 9000 and rows[2].s == ""
    assert time.time() - began < 60
