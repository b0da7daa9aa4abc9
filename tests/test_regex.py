import re

import pytest
from pyspark.sql import functions as F

from textweir.functions.fixed import RULES
from textweir.functions.regex import js_regex, wildcard_regex
from textweir.plans.catalog import PROBES


def found(spark, text, pattern):
    return spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(pattern)).head()[0]


@pytest.mark.parametrize(
    "source,flags,text,expected",
    [
        (r"\buser", "", "éuser", True),
        (r"a\sb", "", "a b", True),
        (r"a[,\s]b", "", "a b", True),
        (r"a.b", "", "a\u0085b", True),
        (r"a.b", "", "a b", False),
        (r"a$", "", "a\n", False),
        (r"^#\s", "m", "x\n# y", True),
        (r"^#\s", "m", "x\u0085# y", False),
        (r"IGNORE", "i", "ignore", True),
        (r"[^@\s]+x", "", " x", False),
    ],
)
def test_dialect(spark, source, flags, text, expected):
    assert found(spark, text, js_regex(source, flags)) is expected


@pytest.mark.parametrize(
    "pattern,name,expected",
    [("*", "a\nb", True), ("delete_*", "delete_user", True), ("delete_*", "x_delete_user", False), ("a?c", "abc", False), ("a?c", "a?c", True), ("a?c*", "abcd", True), ("a.c", "abc", False), ("x*", "x\n", False)],
)
def test_wildcards(spark, pattern, name, expected):
    assert found(spark, name, wildcard_regex(pattern)) is expected


def test_rules_agree_with_python(spark):
    """Java and Python agree on every rule and probe."""
    from textweir.operators.injection import rule_hits

    rows = spark.createDataFrame(list(enumerate(PROBES)), "i int, text string").select("i", rule_hits(F.col("text"))["rule_id"].alias("hits")).collect()
    for row in rows:
        expected = [r.id for r in RULES if re.search(r.pattern, PROBES[row.i], re.ASCII | (re.I if "i" in r.flags else 0))]
        assert row.hits == expected
    assert {h for row in rows for h in row.hits} == {r.id for r in RULES}
