"""Token cost, budgets and spending anomalies."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.functions.arrays import in_chunks
from textweir.functions.fixed import FALLBACK_PRICE, PRICES
from textweir.functions.names import fresh
from textweir.functions.ordered import cell, numbered, running_total, same, with_totals
from textweir.sources.tables import local


class Budget(NamedTuple):
    soft: float
    hard: float
    period: str  # hourly, daily or monthly


UNITS = {"hourly": "hour", "daily": "day", "monthly": "month"}
#: Seconds that a period lasts at most; a counter lives for two of them.
PERIOD_SECONDS = {"hourly": 3600, "daily": 86_400, "monthly": 31 * 86_400}


def prices_table(spark: SparkSession, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    rows = [(i, m, *p) for i, (m, p) in enumerate(prices.items())]
    return local(spark, rows, "ord int, model string, in_per_m double, out_per_m double")


def price(model: Column, prices: Mapping[str, tuple[float, float]] = PRICES, longest_prefix: bool = False) -> Column:
    """struct<input, output> dollars a million tokens: the exact model, else the first declared one
    that is a prefix, else the fallback (C1-C4). `longest_prefix` prefers the longest instead."""
    made = lambda p: F.struct(F.lit(p[0]).alias("input"), F.lit(p[1]).alias("output"))
    exact = [F.when(model == m, made(p)) for m, p in prices.items()]
    names = sorted(prices, key=len, reverse=True) if longest_prefix else prices
    prefix = [F.when(F.startswith(model, F.lit(m)), made(prices[m])) for m in names]
    return F.coalesce(*exact, *prefix, made(FALLBACK_PRICE))


def cost(model: Column, input_tokens: Column, output_tokens: Column, **options) -> Column:
    """Dollars; tokens are divided before they are multiplied."""
    p = price(model, **options)
    return input_tokens / F.lit(1e6) * p["input"] + output_tokens / F.lit(1e6) * p["output"]


def bucket(at: Column, period: str | Column) -> Column:
    """Start of the UTC hour, day or month of a timestamp, in a UTC session."""
    if isinstance(period, str):
        return F.date_trunc(UNITS[period], at)
    return F.when(period == "hourly", F.date_trunc("hour", at)).when(period == "daily", F.date_trunc("day", at)).when(period == "monthly", F.date_trunc("month", at))


def budgets_table(spark: SparkSession, budgets: Mapping[str, Budget]) -> DataFrame:
    return local(spark, [(k, *map(float, v[:2]), v[2]) for k, v in budgets.items()], "entity_id string, soft_limit double, hard_limit double, period string")


def bucket_spend(records: DataFrame, budgets: DataFrame) -> DataFrame:
    """(entity_id, bucket, spend): costs count for their entity and for "global", where those have
    a budget (C7, C8). Records have entity_id, ts and cost; sums are pre-aggregated."""
    owners = F.when(F.col("entity_id") == "global", F.array("entity_id")).otherwise(F.array("entity_id", F.lit("global")))
    each = records.select(F.explode(owners).alias("entity_id"), "ts", "cost").join(budgets, "entity_id")
    return each.groupBy("entity_id", bucket(F.col("ts"), F.col("period")).alias("bucket")).agg(F.sum("cost").alias("spend"))


def current_spend(records: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """(entity_id, bucket, spend) of every budget at a moment; 0 without spending in its bucket."""
    open_ = budgets.select("entity_id", bucket(now, F.col("period")).alias("bucket"))
    spent = bucket_spend(records, budgets)
    return open_.join(spent, ["entity_id", "bucket"], "left").select("entity_id", "bucket", F.coalesce("spend", F.lit(0.0)).alias("spend"))


def live_counters(spent: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """Counters of bucket_spend() that have not expired: those of buckets that began less than two
    periods ago (C12)."""
    seconds = F.create_map(*[x for p, n in PERIOD_SECONDS.items() for x in (F.lit(p), F.lit(2 * n))])
    dated = spent.join(budgets.select("entity_id", "period"), "entity_id")
    return dated.where(now.cast("long") - F.col("bucket").cast("long") < F.element_at(seconds, F.col("period"))).drop("period")


def check(spend: Column, estimate: Column, soft: Column, hard: Column) -> Column:
    """struct<allowed, current_spend, remaining_budget, warning> (C9, C11); null limits: no budget.
    Cents are rounded from the whole value of a double, so 0.185, which is a little less, is 0.18."""
    dollars = lambda c: F.call_function("format_number", c, F.lit("0.00"))
    limit = F.regexp_replace(hard.cast("string"), r"\.0$", "")
    denied = spend + estimate > hard
    warned = spend + estimate > soft
    percent = F.floor(spend / hard * 100 + 0.5).cast("string")
    text = F.when(denied, F.concat(F.lit("Hard budget limit reached: $"), dollars(spend), F.lit(" / $"), limit)).when(
        warned, F.concat(F.lit("Approaching budget: $"), dollars(spend), F.lit(" / $"), limit, F.lit(" ("), percent, F.lit("%)"))
    )
    none = hard.isNull()
    return F.struct(
        F.when(none, True).otherwise(~denied).alias("allowed"),
        F.when(none, 0.0).otherwise(spend).alias("current_spend"),
        F.when(none, F.lit(float("inf"))).when(denied, F.greatest(F.lit(0.0), hard - spend)).otherwise(hard - spend).alias("remaining_budget"),
        F.when(~none, text).alias("warning"),
    )


def check_running(calls: DataFrame, budgets: DataFrame, tie: str, output_tokens: int = 500) -> DataFrame:
    """Budget check of every call against what its entity spent before it in the same bucket
    (C9, C10). Calls have entity_id, model, input_tokens, ts and cost. Adds period, soft_limit,
    hard_limit, bucket, spend and check; input columns of these names are replaced."""
    made = ["period", "soft_limit", "hard_limit", "bucket", "spend", "check"]
    limits = budgets.select("entity_id", "period", "soft_limit", "hard_limit")
    joined = calls.drop(*made).join(limits, "entity_id", "left").withColumn("bucket", bucket(F.col("ts"), F.col("period")))
    total = running_total(joined.where("bucket is not null"), ["entity_id", "bucket"], "ts", tie, "cost", "spend")
    free = joined.where("bucket is null").withColumn("spend", F.lit(0.0))
    estimate = cost(F.col("model"), F.col("input_tokens"), F.lit(output_tokens))
    return total.unionByName(free).withColumn("check", check(F.col("spend"), estimate, F.col("soft_limit"), F.col("hard_limit")))


#: A sum this close to its limit, relative to it, may be rounded to either side of it.
NEAR = 1e-9


def gated(calls: DataFrame, keys: list[str], at: str, tie: str, estimate: str, actual: str, limit: str, replayed: str | None = None) -> DataFrame:
    """Adds allowed and spend where a denied call never counts.

    While nothing has been denied, spend is a running sum, which is taken in two levels; so are the
    calls of a bucket up to the first one that could be denied decided. Only from there on does a
    decision depend on those before: those calls run in order, streaming through sorted partitions
    that hold one sum. `replayed` names a column that tells which they were. Null limits deny
    nothing; null keys are keys; null amounts count 0.
    """
    before, first, here, *other = fresh(calls, "_before", "_first", "_here", *[f"_{k}_of_first" for k in keys])
    kept = [c for c in calls.columns if c not in ("spend", "allowed", replayed)]
    total = running_total(calls.select(kept), keys, at, tie, actual, before).withColumn(here, F.struct(at, tie))
    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    most = F.col(limit).cast("double")
    could = F.col(before) + amount(estimate) > most - NEAR * F.greatest(F.lit(1.0), F.abs(most))
    firsts = total.where(could).groupBy(*keys).agg(F.min(here).alias(first)).select(*[F.col(k).alias(o) for k, o in zip(keys, other)], first)
    marked = total.join(firsts, same(total, firsts, list(zip(keys, other))), "left").drop(*other)
    late = F.col(first).isNotNull() & (F.col(here) >= F.col(first))
    flag = [F.lit(False).alias(replayed)] if replayed else []
    easy = marked.where(~late).select(*kept, F.col(before).alias("spend"), F.lit(True).alias("allowed"), *flag)
    ordered = marked.where(late).select(*kept, before).repartition(*keys).sortWithinPartitions(*keys, at, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, spent = None, 0.0
        for batch in batches:
            spends, oks = [], []
            named = batch[keys].astype(object).where(batch[keys].notna(), None)
            rows = zip(zip(*[named[k] for k in keys]), batch[estimate].fillna(0.0), batch[actual].fillna(0.0), batch[limit], batch[before])
            for key, wanted, real, most, start in rows:
                if key != unit:
                    unit, spent = key, start
                ok = most is None or most != most or spent + wanted <= most
                spends.append(spent)
                oks.append(ok)
                spent += real if ok else 0.0
            done = batch.drop(columns=before).assign(spend=spends, allowed=oks)
            yield done.assign(**{replayed: True}) if replayed else done

    schema = f"{calls.select(kept).schema.simpleString()[7:-1]}, spend double, allowed boolean" + (f", {replayed} boolean" if replayed else "")
    return easy.union(ordered.mapInPandas(run, schema))


def moments(n: Column, mean: Column, m2: Column, low: Column, high: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), mean.alias("mean"), m2.alias("m2"), low.alias("low"), high.alias("high"))


def merged(a: Column, b: Column) -> Column:
    """Count, mean, sum of squared deviations, least and most of two sets of values from theirs."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    both = moments(n, a["mean"] + apart * b["n"] / n, a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n, F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"]))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


MOMENTS = "struct<n:bigint,mean:double,m2:double,low:double,high:double>"


def anomalies(series: DataFrame, entity: str, at: str, value: str, threshold: float = 2.5, history: int | None = None, chunk: str = "month") -> DataFrame:
    """Adds n_history, mean, std_dev, z_score and is_anomaly against earlier values.

    Fewer than three values: no anomaly and z 0. A zero deviation: any difference is one, with
    z infinite. `history` limits how many values count. Null values are no history.

    An entity is spread: moments of its chunks are merged in order, those of a value's own chunk
    are taken within it. With `history`, blocks of rows see a copy of the block before.
    """
    out = ["n_history", "mean", "std_dev", "z_score", "is_anomaly"]
    kept = [c for c in series.columns if c not in out]
    past, *other = fresh(series, "_past", "_chunk", "_own", "_before", "_place", "_block", "_copy")
    cut, own, before, place, block, copy = other
    now = F.col(value).cast("double")
    none = F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double")
    over = lambda w: moments(F.count(now).over(w), F.coalesce(F.avg(now).over(w), F.lit(0.0)), F.coalesce(F.var_pop(now).over(w) * F.count(now).over(w), F.lit(0.0)), F.min(now).over(w), F.max(now).over(w))
    if history is None:
        celled = series.select(*kept, cell(series, at, chunk).alias(cut))
        agg = moments(F.count(now), F.coalesce(F.avg(now), F.lit(0.0)), F.coalesce(F.var_pop(now) * F.count(now), F.lit(0.0)), F.min(now), F.max(now))
        # An entity has as many chunks as its time has: few, however many rows.
        chunks = celled.groupBy(entity, cut).agg(agg.alias(own)).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col(cut).alias("cut"), F.col(own).alias("own")))).alias("all"))
        step = lambda s, c: F.struct(merged(s["last"], c["own"]).alias("last"), F.concat(s["kept"], F.array(F.struct(c["cut"].alias("cut"), s["last"].alias("sum")))).alias("kept"))
        walk = in_chunks(F.col("all"), moments(*none).cast(MOMENTS), step, f"struct<cut:{dict(celled.dtypes)[cut]},sum:{MOMENTS}>")
        sums = chunks.select(entity, F.inline(walk)).select(entity, F.col("cut").alias(cut), F.col("sum").alias(before))
        within = Window.partitionBy(entity, cut).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        joined = with_totals(celled.withColumn(own, over(within)), [entity], cut, sums, [before])
        held = joined.withColumn(past, merged(F.col(before), F.col(own)))
    else:
        size = max(history, 4096)
        placed = numbered(series.select(kept), [entity], at, at, place, chunk)
        nth = F.floor(F.col(place) / size)
        twice = placed.withColumn(block, F.explode(F.array(F.struct(nth.alias("b"), F.lit(False).alias("copy")), F.struct((nth + 1).alias("b"), F.lit(True).alias("copy")))))
        parted = twice.withColumns({copy: F.col(f"{block}.copy"), block: F.col(f"{block}.b")})
        window = Window.partitionBy(entity, block).orderBy(place).rowsBetween(-history, -1)
        held = parted.withColumn(past, over(window)).where(~F.col(copy))
    p = F.col(past)
    flat, std, few = p["low"] == p["high"], F.sqrt(F.try_divide(p["m2"], p["n"])), p["n"] < 3
    mean = F.when(flat, p["low"]).otherwise(p["mean"])
    z = F.when(flat | (std == 0), F.when(now == mean, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(now - mean, std))
    done = held.withColumns(
        {
            "n_history": p["n"],
            "mean": F.when(few, now).otherwise(mean),
            "std_dev": F.when(few, 0.0).when(flat, 0.0).otherwise(std),
            "z_score": F.when(few, 0.0).otherwise(z),
        }
    )
    return done.withColumn("is_anomaly", ~few & F.when(flat, now != mean).otherwise(F.col("z_score") > threshold)).select(*kept, *out)
