"""Running sums, the gate, moments and caches in parts, against row-by-row restatements."""

import collections
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from textweir.functions import ordered
from textweir.operators import cache, cost

START = dt.datetime(2024, 1, 1)


def test_totals_and_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), None if i % 9 == 0 else START + dt.timedelta(minutes=rng.randint(0, 300)), i, None if i % 7 == 0 else float(rng.randint(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int, v double").withColumns({"_sum": F.lit("x"), "_chunk": F.lit("y"), "_k_of_cell": F.lit("z")})
    done = ordered.numbered(ordered.running_total(df, ["k"], "at", "i", "v", "total"), ["k"], "at", "i", "place")
    assert done.columns == [*df.columns, "total", "place"]
    sums, places = collections.Counter(), collections.Counter()
    want = {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[2])):
        want[i] = (float(sums[k]), places[k])
        sums[k] += v or 0.0
        places[k] += 1
    assert {r.i: (r.total, r.place) for r in done.collect()} == want
    assert ordered.numbered(df.where("false"), ["k"], "at", "i", "place").count() == 0


def test_totals_have_the_bits_of_a_loop(spark):
    """Beyond `one_cell` rows a key is spread over hours; its sums may then round elsewhere."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", None]), START + dt.timedelta(minutes=rng.randint(0, 900)), i, rng.random() / 30) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int, v double").withColumns({"_n": F.lit("x"), "_k_of_large": F.lit("y")})
    sums, want = collections.Counter(), {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = float(sums[k])
        sums[k] += v
    done = ordered.running_total(df, ["k"], "at", "i", "v", "total")
    assert done.columns == [*df.columns, "total"] and {r.i: r.total for r in done.collect()} == want
    spread = {r.i: r.total for r in ordered.running_total(df, ["k"], "at", "i", "v", "total", one_cell=200).collect()}
    assert spread == pytest.approx(want, abs=1e-12) and spread.keys() == want.keys()
    assert all(spread[i] == want[i] for k, _, i, _ in rows if k is None)


def gate(rows):
    spent, out = collections.Counter(), {}
    for k, t, i, est, act, most in sorted(rows, key=lambda r: (r[1], r[2])):
        ok = most is None or spent[k] + est <= most
        out[i] = (ok, spent[k])
        spent[k] += act if ok else 0.0
    return out


def test_gate_replays_only_from_the_first_call_that_could_be_denied(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 20_000), i, rng.randint(0, 8) / 8, rng.randint(0, 8) / 8, {"a": 5.0, "b": 1e9, None: 20.0}.get(k)) for i in range(600) for k in [rng.choice(["a", "b", "c", None])]]
    df = spark.createDataFrame(rows, "k string, t int, i int, est double, act double, most double").withColumns({"spend": F.lit("x"), "_before": F.lit("y"), "_first": F.lit("z")})
    done = cost.gated(df, ["k"], "t", "i", "est", "act", "most", replayed="again").collect()
    want = gate(rows)
    assert {r.i: (r.allowed, r.spend) for r in done} == want and len(done) == len(rows)
    assert any(not ok for ok, _ in want.values())
    again = collections.Counter((r.k, r.again) for r in done)
    assert not again["b", True] and not again["c", True] and again["a", False] > 3 and again["a", True]
    first = min(((r.t, r.i) for r in done if r.k == "a" and not r.allowed))
    assert all(not r.again for r in done if r.k == "a" and (r.t, r.i) < first)
    assert cost.gated(df.where("false"), ["k"], "t", "i", "est", "act", "most").count() == 0


def judged(values, history):
    out = []
    for i, v in enumerate(values):
        past = values[:i] if history is None else values[max(0, i - history) : i]
        if len(past) < 3:
            out.append((len(past), v, 0.0, 0.0, False))
            continue
        mean = math.fsum(past) / len(past)
        std = math.sqrt(math.fsum((x - mean) ** 2 for x in past) / len(past))
        if len(set(past)) == 1:
            mean, std = past[0], 0.0
        z = (0.0 if v == mean else math.inf) if std == 0 else (v - mean) / std
        out.append((len(past), mean, std, z, v != mean if std == 0 else z > 2.5))
    return out


@pytest.mark.parametrize("history", [None, 5])
def test_anomalies_in_parts(spark, history):
    rng = random.Random(3)
    series = {
        "steady": [7.1] * 120 + [7.2],
        "far": [1e9 + rng.random() for _ in range(150)],
        "mixed": [rng.choice([0.0, 1.0, 1e6]) for _ in range(150)],
        None: [float(i % 3) for i in range(100)],
    }
    rows = [(k, START + dt.timedelta(days=i), v) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "e string, at timestamp, v double").withColumns({"mean": F.lit("x"), "_past": F.lit("y")})
    done = cost.anomalies(df, "e", "at", "v", history=history).orderBy("e", "at").collect()
    assert len(done) == len(rows)
    for k, values in series.items():
        got = [r for r in done if r.e == k]
        for r, (n, mean, std, z, odd) in zip(got, judged(values, history), strict=True):
            assert (r.n_history, r.is_anomaly) == (n, odd)
            assert r["mean"] == pytest.approx(mean, rel=1e-9) and r.std_dev == pytest.approx(std, rel=1e-6, abs=1e-9)
            assert r.z_score == z or r.z_score == pytest.approx(z, rel=1e-6, abs=1e-5)  # a mean near 1e9 has seven places
    assert cost.anomalies(df.where("false"), "e", "at", "v", history=history).count() == 0


def cached(rows, ttl, capacity):
    held, out = collections.defaultdict(collections.OrderedDict), {}
    for c, k, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        until = held[c].pop(k, None)
        hit = until is not None and at <= until
        if not hit:
            if len(held[c]) >= capacity:
                held[c].popitem(last=False)
            until = at + dt.timedelta(milliseconds=ttl)
        held[c][k] = until
        out[i] = hit
    return out


@pytest.mark.parametrize("capacity, stretch", [(1, 4), (5, 8), (12, 30), (40, None)])
def test_caches_in_stretches(spark, capacity, stretch):
    rng = random.Random(capacity)
    rows = []
    for i in range(900):
        c = rng.choice(["busy", "busy", "busy", "calm", None])
        rows.append((c, rng.choice([None, "hot", "hot", *map(str, range(30))]), START + dt.timedelta(seconds=i * 20 + rng.randint(0, 30)), i))
    df = spark.createDataFrame(rows, "c string, k string, at timestamp, i int").withColumns({"pos": F.lit("x"), "_key": F.lit("y"), "cached": F.lit("z"), "part": F.lit("w")})
    done = cache.replay(df, "c", "k", "at", "i", ttl_ms=600_000, capacity=capacity, stretch=stretch)
    want = cached(rows, 600_000, capacity)
    assert {r.i: r.cached for r in done.collect()} == want and done.count() == len(rows)
    assert any(want.values()) and not all(want.values())
    assert cache.replay(df.where("false"), "c", "k", "at", "i").count() == 0


def test_clashing_columns(spark):
    calls = spark.createDataFrame([(1, "a", "gpt-4o-mini", 10, START, 1.0, "p", 5, "q")], "i int, entity_id string, model string, input_tokens long, ts timestamp, cost double, period string, soft_limit int, check string")
    done = cost.check_running(calls, cost.budgets_table(spark, {"a": cost.Budget(1, 2, "daily")}), "i").head()
    assert done.period == "daily" and done.check.allowed and done.soft_limit == 1.0
    df = spark.createDataFrame([(1, "x", "d"), (2, None, "d"), (3, None, "e")], "i int, text string, decision string")
    once = cache.scan_once(df, F.col("text"), lambda d: d.withColumn("decision", F.coalesce("text", F.lit("none"))), ["decision"])
    assert sorted((r.i, r.decision) for r in once.collect()) == [(1, "x"), (2, "none"), (3, "none")]
