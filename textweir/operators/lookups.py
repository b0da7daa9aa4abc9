"""Rules in large tables: names by wildcards, models by price prefixes, pins by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.functions.fixed import FALLBACK_PRICE
from textweir.functions.names import fresh
from textweir.functions.ordered import cell
from textweir.functions.regex import LINE_ENDS

#: Characters that end the plain part of a wildcard, and those that leave no part plain.
ENDS, NEVER = r"[.^$+?*]", r"[|(){}\[\]\\]"


def wildcard_column(pattern: Column) -> Column:
    """The Java pattern of a column of wildcards, as wildcard_regex() makes it of one."""
    plain = F.concat(F.lit(r"\A\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\z"))
    any_ = F.replace(F.replace(pattern, F.lit("*"), F.lit(f"[^{LINE_ENDS}]*")), F.lit("?"), F.lit(f"[^{LINE_ENDS}]"))
    return F.when(pattern == "*", F.lit(r"(?s)\A.*\z")).when(F.contains(pattern, F.lit("*")), F.concat(F.lit("^"), any_, F.lit(r"\z"))).otherwise(plain)


def index_key(pattern: Column) -> Column:
    """What every name that a wildcard matches begins or ends with: "p" and its plain beginning, or
    "s" and its plain end; "=" and all of it without a *; "" where nothing is plain."""
    begin, end = F.split(pattern, ENDS, 2)[0], F.regexp_extract(pattern, r"[^.^$+?*]*$", 0)
    # A repeated character can be missing; a plus keeps one.
    open_ = F.when(F.length(begin) > 0, F.concat(F.lit("p"), begin)).when(F.length(end) > 0, F.concat(F.lit("s"), end)).otherwise("")
    return F.when(~F.contains(pattern, F.lit("*")), F.concat(F.lit("="), pattern)).when(F.rlike(pattern, F.lit(NEVER)), "").otherwise(open_)


def wildcard_index(agents: DataFrame) -> DataFrame:
    """(agent_id, allow, place, pattern, index_key) of a table (agent_id, allowed, denied): a row for
    each wildcard, to be joined by agent and key."""
    listed = lambda c, allow: agents.select("agent_id", F.lit(allow).alias("allow"), F.posexplode(c).alias("place", "pattern"))
    return listed("allowed", True).union(listed("denied", False)).withColumn("index_key", index_key(F.col("pattern")))


def matched_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """(agent_id, name, allowed, rule) of distinct (agent_id, name): whether any allowing wildcard of
    the agent matches, and the first denying one that does.

    A name joins the wildcards whose plain beginning or end it has (only lengths that the index
    has are tried) or that have none, and regular expressions run on those alone.
    """
    kinds = F.substring("index_key", 1, 1)
    # A few distinct lengths, however many wildcards.
    lengths = [(r[0], r[1]) for r in index.where("index_key <> ''").select(kinds, F.length("index_key") - 1).distinct().collect()]
    parts = {k: F.array(*[F.lit(n) for n in sorted(n for kind, n in lengths if kind == k)]).cast("array<int>") for k in "ps"}
    size = F.length("name")
    short = lambda k: F.filter(parts[k], lambda n: n <= size)
    keys = F.concat(
        F.array(F.lit(""), F.concat(F.lit("="), "name")),
        F.transform(short("p"), lambda n: F.concat(F.lit("p"), F.substring("name", F.lit(1), n))),
        F.transform(short("s"), lambda n: F.concat(F.lit("s"), F.substring("name", size - n + 1, n))),
    )
    asked = names.select("agent_id", "name", F.explode(keys).alias("index_key"))
    tried = asked.join(index, ["agent_id", "index_key"]).where(F.rlike("name", wildcard_column(F.col("pattern"))))
    first = F.min(F.when(~F.col("allow"), F.struct("place", "pattern")))
    return tried.groupBy("agent_id", "name").agg(F.coalesce(F.max("allow"), F.lit(False)).alias("allowed"), first["pattern"].alias("rule"))


def priced(calls: DataFrame, prices: DataFrame, longest_prefix: bool = False) -> DataFrame:
    """Adds in_per_m, out_per_m and cost to calls (model, input_tokens, output_tokens) by a table of
    prices (ord, model, in_per_m, out_per_m), as price() does with literals (C1-C5).

    Each distinct model joins the prices of its beginnings, of lengths that the table has; of those
    the model itself wins, then the first declared, or the longest with `longest_prefix`; the
    fallback where there is none. Null models get it too; rows that repeat are priced each.
    """
    made = ["in_per_m", "out_per_m", "cost"]
    kept = [c for c in calls.columns if c not in made]
    lengths = [r[0] for r in prices.select(F.length("model")).distinct().collect() if r[0] is not None]
    (of,) = fresh(calls, "_of_model")
    names = calls.select("model").distinct().where("model is not null")
    sizes = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("model"))
    asked = names.select(F.col("model").alias(of), F.explode(sizes).alias("n")).select(of, F.substring(of, F.lit(1), F.col("n")).alias("model"))
    order = F.struct((F.col("model") != F.col(of)).alias("other"), (-F.length("model") if longest_prefix else F.lit(0)).alias("length"), "ord", "in_per_m", "out_per_m")
    best = asked.join(prices, "model").groupBy(of).agg(F.min(order).alias("best")).select(of, *[F.col(f"best.{c}").alias(c) for c in made[:2]])
    joined = calls.select(kept).join(best, F.col("model") == F.col(of), "left").drop(of)
    filled = joined.withColumns({c: F.coalesce(c, F.lit(p)) for c, p in zip(made, FALLBACK_PRICE)})
    return filled.withColumn("cost", F.col("input_tokens") / F.lit(1e6) * F.col("in_per_m") + F.col("output_tokens") / F.lit(1e6) * F.col("out_per_m"))


def pins_as_of(calls: DataFrame, history: DataFrame, at: str = "ts", chunk: str = "hour") -> DataFrame:
    """Adds pinned_at and known_tools to calls (server_id, time): of the pins (server_id, pinned_at,
    known_tools) of its server the latest that is not after the call (A13, T7); null without.

    Calls and pins are merged by time within an hour of a server, and each hour gets the pin that
    held at its start from the merge of pins with the hours alone, so a busy server is spread. Of
    pins at the same time the one whose tools sort last holds. Calls without a server or a time
    have no pin.
    """
    made = ["pinned_at", "known_tools"]
    cut, when, pin, old, mine = fresh(calls, "_hour", "_when", "_pin", "_old", "_is_call")
    kept = [c for c in calls.columns if c not in made]
    held = F.struct("pinned_at", F.col("known_tools").alias("tools"))
    pins = history.where("server_id is not null and pinned_at is not null").select("server_id", F.col("pinned_at").alias(when), held.alias(pin)).groupBy("server_id", when).agg(F.max(pin).alias(pin))
    pins = pins.withColumn(cut, cell(pins, when, chunk))
    rows = calls.select(*kept, F.col(at).cast("timestamp").alias(when)).withColumn(mine, F.lit(True))
    rows = rows.withColumn(cut, cell(rows, when, chunk))
    hours = rows.where(F.col("server_id").isNotNull() & F.col(cut).isNotNull()).select("server_id", cut).distinct()
    # An hour's mark stands before all that is in the hour.
    marks = hours.withColumns({when: F.col(cut), mine: F.lit(0)}).unionByName(pins.withColumn(mine, F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy("server_id").orderBy(when, mine).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn(old, F.last(pin, True).over(before)).where(F.col(mine) == 0).select("server_id", cut, old)
    both = rows.unionByName(pins, allowMissingColumns=True)
    inside = Window.partitionBy("server_id", cut).orderBy(when, F.col(mine).isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn(pin, F.last(pin, True).over(inside)).where(F.col(mine)).drop(mine)
    done = seen.join(carried, ["server_id", cut], "left").withColumn(pin, F.when(F.col("server_id").isNotNull() & F.col(when).isNotNull(), F.coalesce(pin, old)))
    return done.select(*kept, F.col(f"{pin}.pinned_at").alias("pinned_at"), F.col(f"{pin}.tools").alias("known_tools"))
