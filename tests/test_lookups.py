"""Wildcards, prices and pins in tables, and look-ups of audit records, against plain restatements."""

import datetime as dt
import random
import re
from functools import lru_cache

from pyspark.sql import functions as F

from textweir.operators import cost, lookups, policy
from textweir.sources import tables

START = dt.datetime(2024, 1, 1)


@lru_cache(None)
def compiled(pattern):
    return re.compile("^" + pattern.replace("*", ".*").replace("?", ".") + r"\Z")


def wild(pattern, name):
    if pattern == "*":
        return True
    return compiled(pattern).fullmatch(name) is not None if "*" in pattern else pattern == name


def test_thousands_of_wildcards(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab_.+?(|)x") for _ in range(rng.randint(0, 4)))
    patterns = []
    while len(patterns) < 10_000:
        p = rng.choice([f"{word()}*", f"*{word()}", f"{word()}*{word()}", word(), f"a{len(patterns)}_*", "*", f"read_{len(patterns)}"])
        try:
            re.compile(p.replace("*", ".*"))
        except re.error:
            continue
        if not re.search(r"[?+*]\?|\+\+|\?\+|\*\+|^\+|\(\+|\|\+|\(\?|^\?", p.replace("?", ".").replace("*", ".*")):
            patterns.append(p)
    rest = [p for p in patterns if p != "*"]
    agents = {"many": (rest[:6000], rest[6000:]), "star": (["*"], ["a*", "ab*"]), "none": ([], []), "default": (["read_*"], ["*_x"])}
    table = spark.createDataFrame([(a, *p) for a, p in agents.items()], "agent_id string, allowed array<string>, denied array<string>")
    names = sorted({word() + rng.choice(["", "_x", "b"]) for _ in range(150)} | {"", "a17_z", "read_5", "ab", "x" * 3_000})
    calls = [(i, a, n) for i, (a, n) in enumerate((a, n) for a in [*agents, "unknown", None] for n in names)]
    df = spark.createDataFrame([*calls, *calls[:5]], "i int, agent_id string, name string").withColumns({"server_id": F.lit(None).cast("string"), "_rule": F.lit("x"), "pattern": F.lit("y"), "decision": F.lit("z"), "known_tools": F.lit("w")})
    pins = spark.createDataFrame([], "server_id string, known_tools array<string>")
    done = policy.check_calls(df, table, pins).collect()
    assert len(done) == len(calls) + 5 and done[0].known_tools == "w"
    for r in done:
        allowed, denied = agents.get(r.agent_id or "default", (["*"], []))
        rule = next((p for p in denied if wild(p, r.name)), None)
        want = [f"Matched deny pattern: {rule}"] if rule is not None else [] if any(wild(p, r.name) for p in allowed) else [None]
        assert [v.detail for v in r.violations] == want, (r.agent_id, r.name)
    frozen = policy.check_calls(df.limit(3), table, pins, read_only=True).collect()
    assert all(r.violations[0].message.endswith("blocked: read-only mode active") for r in frozen)
    assert policy.check_calls(df.where("false"), table, pins).count() == 0


def test_price_tables(spark):
    rng = random.Random(2)
    models = list(dict.fromkeys("m" + "".join(rng.choice("ab-") for _ in range(rng.randint(0, 12))) for _ in range(30_000)))[:10_000]
    prices = {m: (float(i % 50), float(i % 70)) for i, m in enumerate(models)}
    asked = [rng.choice(models) + rng.choice(["", "", "a", "-x", "b-2024"]) for _ in range(300)] + ["other", "", None, models[0], models[0]]
    df = spark.createDataFrame([(i, m, 1000 * i, i) for i, m in enumerate(asked)], "i int, model string, input_tokens long, output_tokens long").withColumns({"cost": F.lit("x"), "n": F.lit("y"), "ord": F.lit("z")})
    for longest in (False, True):
        got = {r.i: (r.in_per_m, r.out_per_m, r.cost) for r in lookups.priced(df, cost.prices_table(spark, prices), longest).collect()}
        for i, m in enumerate(asked):
            fits = [p for p in prices if m is not None and m.startswith(p)]
            best = m if m in prices else max(fits, key=len) if fits and longest else fits[0] if fits else None
            p = prices[best] if best is not None else cost.FALLBACK_PRICE
            assert got[i] == (p[0], p[1], 1000 * i / 1e6 * p[0] + i / 1e6 * p[1])
    assert lookups.priced(df.where("false"), cost.prices_table(spark)).count() == 0


def test_pins_of_a_time(spark):
    rng = random.Random(3)
    at = lambda: START + dt.timedelta(minutes=rng.randint(0, 2000))
    pins = list({(s, t): (s, t, [f"tool{i}"]) for i, (s, t) in enumerate((rng.choice(["s", "busy", "late"]), at()) for _ in range(60))}.values()) + [(None, START, ["x"]), ("s", None, ["x"])]
    pins = [p if p[0] != "late" else (p[0], p[1] + dt.timedelta(days=5), p[2]) for p in pins]
    calls = [(i, rng.choice(["busy", "busy", "s", "late", "unknown", None]), None if i % 40 == 0 else at()) for i in range(400)]
    calls += [(1000 + i, p[0], p[1]) for i, p in enumerate(pins)]  # at the very time
    df = spark.createDataFrame(calls, "i int, server_id string, ts timestamp").withColumns({"_pin": F.lit("x"), "_hour": F.lit("y")})
    history = spark.createDataFrame(pins, "server_id string, pinned_at timestamp, known_tools array<string>")
    done = lookups.pins_as_of(df.union(df), history).collect()
    assert len(done) == 2 * len(calls)
    for r in done:
        held = [(t, k) for s, t, k in pins if s == r.server_id and s and t and r.ts and t <= r.ts]
        assert (r.pinned_at, r.known_tools) == (max(held) if held else (None, None))
    assert lookups.pins_as_of(df, history.where("false")).where("known_tools is not null").count() == 0
    assert lookups.pins_as_of(df.where("false"), history).count() == 0


def test_history_of_pins(spark, tmp_path):
    path = f"{tmp_path}/pins"
    pin = lambda *names: policy.pin_manifests(spark.createDataFrame([("s", n) for n in names], "server_id string, name string"))
    tables.write_pins(pin("a"), path, F.lit(START).cast("timestamp"))
    tables.write_pins(pin("a", "b"), path, F.lit(START + dt.timedelta(days=2)).cast("timestamp"))
    history = spark.read.parquet(path)
    assert tables.latest_pins(history).head().known_tools == ["a", "b"] and history.count() == 2
    calls = spark.createDataFrame([(i, "x", "b", "s", START + dt.timedelta(days=i, hours=-1)) for i in range(4)], "i int, agent_id string, name string, server_id string, ts timestamp")
    agents = policy.policy_tables(spark, policy.ToolPolicy())[0]
    got = {r.i: [(v.type, v.detail) for v in r.violations] for r in policy.check_calls(calls, agents, history, at="ts").collect()}
    drift = [("manifest_drift", "Known tools: a")]
    assert got == {0: [], 1: drift, 2: drift, 3: []}


def test_presets_give_depth_and_budget(spark):
    entities = spark.createDataFrame([("e", "internal_support"), ("f", None), ("g", "nope")], "entity_id string, preset string")
    got = {r.entity_id: (r.soft_limit, r.hard_limit, r.period) for r in policy.preset_budgets(entities).collect()}
    want = lambda p: (p.daily_budget * p.warn_at_percent / 100, p.daily_budget, "daily")
    assert got == {"e": want(policy.preset("internal_support")), "f": want(policy.preset()), "g": want(policy.preset())}
    calls = spark.createDataFrame([(1, 9, 3), (2, 3, 3), (3, 9, None), (4, None, 3)], "i int, depth int, most int").withColumns({"s": F.lit("x"), "p": F.lit("x"), "name": F.lit("n")})
    limits = policy.limit_calls(calls, "s", "i", "depth", per_session=3, max_depth=F.col("most")).collect()
    assert {r.i: r.limits for r in limits} == {1: ["chain_depth"], 2: [], 3: [], 4: ["session_limit"]}


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_audit_look_ups(spark, tmp_path):
    schema = tables.schema_of(tables.AUDIT_SCHEMA)
    rows = []
    for i in range(6000):
        at = START + dt.timedelta(hours=i % 2000)
        kinds = [["pii_detected"], [], ["prompt_injection", "pii_detected", "pii_detected"], None][i % 4] if i % 2000 < 1000 else []
        said = None if kinds is None else "[" + ",".join(f'{{"type":"{k}","message":"m"}}' for k in kinds) + "]"
        rows.append((str(i), at, f"session-{(i * 7919) % 6000}", "a", None, "chat", "h", 1, "m", "warn", None, said, at.date().replace(day=1)))
    records = spark.createDataFrame(rows, schema).repartition(3)
    tables.write_searchable(records, f"{tmp_path}/audit")
    stored = tables.read_audit(spark, f"{tmp_path}/audit")
    one = stored.where("session_id = 'session-77'").select("id")
    absent = stored.where("session_id = 'session-7x'").select("id")  # between the least and the most of every file
    assert len(one.collect()) == 1 and rows_read(absent) == 0 and rows_read(one) < 6000
    tables.write_violation_index(records, f"{tmp_path}/index")
    index = spark.read.schema(tables.VIOLATION_INDEX).parquet(f"{tmp_path}/index")
    first, last = dt.date(2024, 1, 20), dt.date(2024, 2, 3)
    for kind in ("prompt_injection", "pii_detected", "none"):
        found = tables.with_violation(stored, index, kind, first, last)
        want = sorted(r[0] for r in rows if r[11] and f'"{kind}"' in r[11] and first <= r[1].date() <= last)
        assert sorted(r.id for r in found.collect()) == want
    late = tables.with_violation(stored, index, "pii_detected", dt.date(2024, 2, 20), dt.date(2024, 3, 20))
    assert late.count() == 0
    plan = index.where("violation_type = 'prompt_injection'")
    assert {f.split("violation_type=")[1].split("/")[0] for f in plan.inputFiles()} >= {"prompt_injection"} and "PartitionFilters: [isnotnull(violation_type" in plan._jdf.queryExecution().toString()
