"""Tool policies, manifest pins and presets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.functions.fixed import PRESETS, Preset
from textweir.functions.names import fresh
from textweir.functions.ordered import numbered
from textweir.functions.regex import wildcard_regex
from textweir.sources.tables import local

from .injection import NO_VIOLATIONS
from .lookups import matched_names, pins_as_of, wildcard_index


@dataclass(frozen=True)
class Permissions:
    """Wildcards of tools that an agent may and may not call."""

    allowed: Sequence[str] = ("*",)
    denied: Sequence[str] = ()


@dataclass(frozen=True)
class ToolPolicy:
    """`pins` maps a server to its known tools. Agents without permissions are not checked."""

    permissions: Mapping[str, Permissions] = field(default_factory=dict)
    dangerous: Sequence[str] = ()
    read_only: bool = False
    pins: Mapping[str, Sequence[str]] = field(default_factory=dict)


def preset(name: str | None = None) -> Preset:
    """A preset by name, public_website by default."""
    return PRESETS.get(name or "public_website", PRESETS["public_website"])


def pii_action(name: str | None, key: str | None = None) -> str:
    """Action of a preset for a key such as creditCard, else its default."""
    chosen = preset(name)
    return chosen.pii_by_key.get(key or "", chosen.pii_action)


def threshold_of(name: Column) -> Column:
    """Threshold of each row's preset, the default's for null and unknown names."""
    known = F.create_map(*[x for p in PRESETS.values() for x in (F.lit(p.name), F.lit(p.threshold))])
    return F.coalesce(F.try_element_at(known, F.coalesce(name, F.lit(""))), F.lit(preset().threshold))


def presets_table(spark: SparkSession) -> DataFrame:
    """The presets as a small table for joins by preset name."""
    rows = [(p.name, p.threshold, p.pii_action, list(p.dangerous), p.max_chain_depth, p.daily_budget, p.warn_at_percent) for p in PRESETS.values()]
    return local(spark, rows, "preset string, threshold double, pii_action string, dangerous array<string>, max_chain_depth int, daily_budget double, warn_at_percent int")


def preset_budgets(entities: DataFrame) -> DataFrame:
    """(entity_id, soft_limit, hard_limit, period) of entities (entity_id, preset): the daily budget
    of their preset, soft at its warning percentage (E4); the default's for null and unknown names."""
    presets = presets_table(entities.sparkSession).select("preset", "daily_budget", "warn_at_percent")
    names = F.when(F.col("preset").isin(*PRESETS), F.col("preset")).otherwise(preset().name)
    return entities.select("entity_id", names.alias("preset")).join(presets, "preset").select("entity_id", (F.col("daily_budget") * F.col("warn_at_percent") / 100).alias("soft_limit"), F.col("daily_budget").alias("hard_limit"), F.lit("daily").alias("period"))


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """Whether any wildcard matches."""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(wildcard_regex(p))
    return out


def first_match(name: Column, patterns: Sequence[str]) -> Column:
    """The first wildcard that matches, or null (T5)."""
    tests = [F.when(name.rlike(wildcard_regex(p)), p) for p in patterns]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def violation(kind: str, message: Column, detail: Column | None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit("tool_policy").alias("scanner"),
        F.lit(1.0).alias("score"),
        F.lit(0.0).alias("threshold"),
        message.alias("message"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def tool_violations(tools: Column, agent: Column, policy: ToolPolicy) -> Column:
    """Violations of the calls array<struct<name, server_id>> of an agent, in order.

    A dangerous tool, read-only mode or a denied tool ends the checks of a call; a tool that is
    not allowed is still checked against its server's pin. A null agent is "default".
    """
    agent = F.coalesce(agent, F.lit("default"))

    def denied(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for who, p in policy.permissions.items():
            out = F.when(agent == who, first_match(name, p.denied)).otherwise(out)
        return out

    def refused(name: Column) -> Column:
        out = F.lit(False)
        for who, p in policy.permissions.items():
            out = F.when(agent == who, ~matches_any(name, p.allowed)).otherwise(out)
        return out

    def known(server: Column) -> Column:
        out = F.lit(None).cast("array<string>")
        for who, names in policy.pins.items():
            out = F.when(server == who, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(out)
        return out

    def of(tool: Column) -> Column:
        name, server = tool["name"], tool["server_id"]
        said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        pin = known(server)
        unlisted = F.when(refused(name), violation("tool_denied", said("Tool '", name, "' not in allow list for agent '", agent, "'"), None))
        drift = F.when(
            pin.isNotNull() & (F.length(server) > 0) & ~F.array_contains(pin, name),
            violation("manifest_drift", said("Tool '", name, "' not in pinned manifest for server '", server, "'"), said("Known tools: ", F.array_join(pin, ", "))),
        )
        rule = denied(name)
        listed = F.array(violation("tool_denied", said("Tool '", name, "' denied for agent '", agent, "'"), said("Matched deny pattern: ", rule)))
        rest = F.when(rule.isNotNull(), listed).otherwise(F.array_compact(F.array(unlisted, drift)))
        if policy.read_only:
            rest = F.array(violation("tool_denied", said("Tool '", name, "' blocked: read-only mode active"), None))
        danger = F.array(violation("tool_denied", said("Tool '", name, "' matches global dangerous pattern"), F.lit("Matched global.dangerousPatterns")))
        return F.when(matches_any(name, policy.dangerous), danger).otherwise(rest).cast(NO_VIOLATIONS)

    return F.coalesce(F.flatten(F.transform(tools, of)), F.array().cast(NO_VIOLATIONS))


def tool_decision(violations: Column) -> Column:
    return F.when(F.size(violations) > 0, "block").otherwise("allow")


def manifest_hash(names: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(names), ","), 256)


def pin_manifests(tools: DataFrame, server: str = "server_id", name: str = "name") -> DataFrame:
    """(server_id, tools_hash, tool_count, known_tools) of each server's tools.

    A server's list is its manifest and so small; repeated names count as they do in a list.
    """
    names = F.sort_array(F.collect_list(name))
    return tools.groupBy(F.col(server).alias("server_id")).agg(names.alias("known_tools")).select(
        "server_id", manifest_hash(F.col("known_tools")).alias("tools_hash"), F.size("known_tools").alias("tool_count"), "known_tools"
    )


def verify_manifests(pins: DataFrame, current: DataFrame) -> DataFrame:
    """Compares pins with pin_manifests() of today: valid, added, removed.

    Servers without tools today have all removed; servers without a pin are not verified.
    """
    now = current.select("server_id", F.col("tools_hash").alias("hash_now"), F.col("known_tools").alias("now"))
    empty = F.array().cast("array<string>")
    both = pins.join(now, "server_id", "left").withColumn("now", F.coalesce("now", empty))
    valid = F.coalesce(F.col("hash_now"), manifest_hash(empty)) == F.col("tools_hash")
    missing = lambda a, b: F.when(valid, empty).otherwise(F.filter(a, lambda x: ~F.array_contains(b, x)))
    return both.select("server_id", valid.alias("valid"), missing(F.col("now"), F.col("known_tools")).alias("added"), missing(F.col("known_tools"), F.col("now")).alias("removed"))


def policy_tables(spark: SparkSession, policy: ToolPolicy) -> tuple[DataFrame, DataFrame]:
    """A policy as tables (agent_id, allowed, denied) and (server_id, known_tools) for check_calls()."""
    agents = [(who, list(p.allowed), list(p.denied)) for who, p in policy.permissions.items()]
    pins = [(server, list(names)) for server, names in policy.pins.items()]
    return local(spark, agents, "agent_id string, allowed array<string>, denied array<string>"), local(spark, pins, "server_id string, known_tools array<string>")


def check_calls(calls: DataFrame, agents: DataFrame, pins: DataFrame, dangerous: Sequence[str] = (), read_only: bool | Column = False, at: str | None = None) -> DataFrame:
    """Adds decision and violations to calls (agent_id, name, server_id) by policies in tables
    (T2-T8): `agents` has agent_id, allowed and denied, `pins` server_id and known_tools, such as
    pin_manifests() gives, each name once. Checks and order are those of tool_violations(); agents
    and servers that are not in the tables are not checked. `read_only` holds for all calls or by
    row. With `at`, a column of times, `pins` is their history (with pinned_at) and each call is
    judged by the pin of its time. Every call stays, also with a null agent ("default") or server.

    Wildcards are rows of an index: each distinct agent and name tries those that can match.
    """
    known, who, allowed, rule, checked, other, named = fresh(calls, "_known", "_agent", "_allowed", "_rule", "_checked", "_for_agent", "_for_name")
    kept = [c for c in calls.columns if c not in ("violations", "decision")]
    asked = calls.select(*kept, F.coalesce("agent_id", F.lit("default")).alias(who))
    names = asked.select(F.col(who).alias("agent_id"), "name").distinct()
    listed = names.join(agents.select("agent_id").distinct(), "agent_id").join(matched_names(names, wildcard_index(agents)), ["agent_id", "name"], "left")
    judged = listed.select(F.col("agent_id").alias(other), F.col("name").alias(named), F.coalesce("allowed", F.lit(False)).alias(allowed), F.col("rule").alias(rule), F.lit(True).alias(checked))
    joined = asked.join(judged, asked[who].eqNullSafe(judged[other]) & asked["name"].eqNullSafe(judged[named]), "left").drop(other, named)
    if at is None:
        pinned = joined.join(pins.select("server_id", F.col("known_tools").alias(known)), "server_id", "left")
    else:
        # Columns of the calls with the names of the pin's step aside meanwhile.
        mine = {c: n for c, n in zip(("pinned_at", "known_tools"), fresh(joined, "_pinned_at", "_known_tools")) if c in kept}
        pinned = pins_as_of(joined.withColumnsRenamed(mine), pins, mine.get(at, at)).withColumnRenamed("known_tools", known).drop("pinned_at").withColumnsRenamed({n: c for c, n in mine.items()})
    name, server, agent = F.col("name"), F.col("server_id"), F.col(who)
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    danger = F.array(violation("tool_denied", said("Tool '", name, "' matches global dangerous pattern"), F.lit("Matched global.dangerousPatterns")))
    frozen = F.array(violation("tool_denied", said("Tool '", name, "' blocked: read-only mode active"), None))
    refused = F.array(violation("tool_denied", said("Tool '", name, "' denied for agent '", agent, "'"), said("Matched deny pattern: ", F.col(rule))))
    unlisted = F.when(F.col(checked) & ~F.col(allowed), violation("tool_denied", said("Tool '", name, "' not in allow list for agent '", agent, "'"), None))
    drift = F.when(
        (F.length(server) > 0) & ~F.array_contains(known, name),
        violation("manifest_drift", said("Tool '", name, "' not in pinned manifest for server '", server, "'"), said("Known tools: ", F.array_join(known, ", "))),
    )
    only_reads = read_only if isinstance(read_only, Column) else F.lit(read_only)
    found = F.when(matches_any(name, dangerous), danger).when(only_reads, frozen).when(F.col(rule).isNotNull(), refused).otherwise(F.array_compact(F.array(unlisted, drift))).cast(NO_VIOLATIONS)
    done = pinned.withColumn("violations", found).withColumn("decision", tool_decision(F.col("violations")))
    return done.select(*kept, "decision", "violations")


def call_rates(calls: DataFrame, agent: str, at: str, per_minute: int) -> DataFrame:
    """Adds calls_last_minute and over_limit for each call of an agent (T11, an extension).

    Calls are counted by agent and second first. A minute's seconds, and copies of those of the
    minute before, make one window, so a busy agent is spread over its minutes. Calls without a
    time or an agent count among themselves by what they have.
    """
    second, minute, n, here, recent = fresh(calls, "_second", "_minute", "_n", "_here", "_recent")
    timed = calls.withColumn(second, F.col(at).cast("timestamp").cast("long"))
    by = F.coalesce(F.col(second), F.lit(-1))
    counts = timed.groupBy(agent, second).agg(F.count("*").alias(n))
    own = F.floor(by / 60)
    twice = counts.select(agent, second, n, F.explode(F.array(F.struct(own.alias("m"), F.lit(True).alias("own")), F.struct((own + 1).alias("m"), F.lit(False).alias("own")))).alias(minute))
    span = Window.partitionBy(agent, f"{minute}.m").orderBy(second).rangeBetween(-59, 0)
    sums = twice.withColumn(recent, F.sum(n).over(span)).where(F.col(minute)["own"]).select(F.col(agent).alias(here), F.col(second).alias(minute), F.col(recent).alias("calls_last_minute"))
    same = timed[agent].eqNullSafe(sums[here]) & timed[second].eqNullSafe(sums[minute])
    joined = timed.join(sums, same, "left").select(*[timed[c] for c in calls.columns if c not in ("calls_last_minute", "over_limit")], "calls_last_minute")
    return joined.withColumn("over_limit", F.col("calls_last_minute") > per_minute)


def limit_calls(calls: DataFrame, session: str, tie: str, depth: str | None = None, per_session: int | None = None, approvals: Sequence[str] = (), max_depth: int | Column | None = None) -> DataFrame:
    """Adds `limits`, the names of the limits that a call breaks or meets (T11, E4): calls of its
    session in order of `tie` beyond `per_session`, tools that need approval (wildcards over
    `name`), and chains deeper than `max_depth`, which can come by row, such as max_chain_depth of
    presets_table(). Null sessions, depths and maxima break no limit.

    Numbers of calls are sums over ranges of `tie` first, so a long session is spread.
    """
    tests = []
    (nth,) = fresh(calls, "_nth")
    out = calls
    if per_session is not None:
        out = numbered(calls, [session], tie, tie, nth)
        tests.append(F.when(F.col(session).isNotNull() & (F.col(nth) >= per_session), "session_limit"))
    if approvals:
        tests.append(F.when(matches_any(F.col("name"), approvals), "needs_approval"))
    if max_depth is not None and depth is not None:
        tests.append(F.when(F.col(depth) > max_depth, "chain_depth"))
    made = F.array_compact(F.array(*tests)) if tests else F.array()
    return out.withColumn("limits", made.cast("array<string>")).drop(nth)
