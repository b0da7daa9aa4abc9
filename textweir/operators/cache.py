"""Result caching: keys, batch reuse and replay of a cache with expiry."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.functions.names import fresh
from textweir.functions.ordered import numbered


def cache_key(text: Column, preset: Column, tools: Column | None = None, agent: Column | None = None) -> Column:
    """Hash of preset, sorted tool names and text (L5). Giving an agent keeps agents apart."""
    parts = [F.coalesce(preset, F.lit("default"))]
    if agent is not None:
        parts.append(F.coalesce(agent, F.lit("default")))
    if tools is not None:
        names = F.array_join(F.sort_array(F.transform(tools, lambda t: t["name"])), ",")
        parts.append(F.when(F.size(tools) > 0, names))
    return F.sha2(F.concat_ws("\0", *parts, text), 256)


def scan_once(df: DataFrame, key: Column, scan: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Scans each distinct key once and joins the result columns back (L7); input columns of their
    names are replaced. Rows with a null key are scanned as one."""
    name, other = fresh(df, "_key", "_scanned_key")
    keyed = df.withColumn(name, key)
    scanned = scan(keyed.dropDuplicates([name])).select(F.col(name).alias(other), *columns)
    kept = keyed.drop(*columns)
    return kept.join(scanned, kept[name].eqNullSafe(scanned[other]), "left").drop(name, other)


#: A stretch of a cache's look-ups is so many times as long as what it can hold.
STRETCH = 16


def touched(held: OrderedDict, key: str, capacity: int) -> None:
    """Makes a key the most recent one of those that are held, and lets the least recent one go."""
    held.pop(key, None)
    held[key] = None
    if len(held) > capacity:
        held.popitem(last=False)


def replay(events: DataFrame, cache: str, key: str, at: str, tie: str, ttl_ms: int = 300_000, capacity: int = 1000, stretch: int | None = None) -> DataFrame:
    """Adds cached: whether a look-up hits the cache `cache` it goes to.

    A look-up that misses stores its key; an entry lives for ttl_ms from then, a hit does not renew
    it but makes it the most recent one, and at capacity the least recent one goes.

    Every look-up makes its key the most recent, hit or not, so which keys are held does not depend
    on lifetimes. A cache's look-ups are cut to stretches: of each, the last `capacity` keys by last
    use are found by sums; merged in order they give what is held where a stretch begins; then all
    stretches of a cache are replayed at the same time. Lifetimes run by key, in order of time,
    holding one. Null caches and keys are a cache and a key; look-ups without a time come first and
    outlive nothing.
    """
    stretch = stretch or STRETCH * capacity
    kept = [c for c in events.columns if c != "cached"]
    c_, k_, pos = fresh(events, "_cache", "_key", "_pos")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = numbered(events.select(*kept, text(cache).alias(c_), text(key).alias(k_)), [c_], at, tie, pos)
    looks = rows.select(F.col(c_).alias("c"), F.col(k_).alias("k"), F.col(pos).alias("pos"), F.floor(F.col(pos) / stretch).alias("part"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"))
    last = looks.groupBy("c", "part", "k").agg(F.max("pos").alias("pos"))
    recent = last.withColumn("nth", F.row_number().over(Window.partitionBy("c", "part").orderBy(F.desc("pos")))).where(F.col("nth") <= capacity)

    def stacks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What is held where each stretch after the first begins, least recent first."""
        unit, part, held = None, None, OrderedDict()
        for batch in batches:
            out = []
            for c, p, k in zip(batch["c"], batch["part"], batch["k"]):
                if (c, p) != (unit, part):
                    if c != unit:
                        held = OrderedDict()
                    else:
                        out += [(c, p, i - len(held), x) for i, x in enumerate(held)]
                    unit, part = c, p
                touched(held, k, capacity)
            yield pd.DataFrame(out, columns=["c", "part", "pos", "k"])

    begun = recent.select("c", "part", "pos", "k").repartition("c").sortWithinPartitions("c", "part", "pos").mapInPandas(stacks, "c string, part long, pos long, k string")
    # Entries of a stack stand before the first look-up of their stretch.
    both = begun.withColumns({"ms": F.lit(None).cast("long"), "old": F.lit(True)}).unionByName(looks.withColumn("old", F.lit(False)))
    ordered = both.repartition("c", "part").sortWithinPartitions("c", "part", F.desc("old"), "pos")

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held = None, OrderedDict()
        for batch in batches:
            there = []
            for c, p, k in zip(batch["c"], batch["part"], batch["k"]):
                if (c, p) != unit:
                    unit, held = (c, p), OrderedDict()
                there.append(k in held)
                touched(held, k, capacity)
            yield batch.assign(there=there)[~batch["old"]][["c", "k", "pos", "ms", "there"]]

    timed = ordered.mapInPandas(hold, "c string, k string, pos long, ms long, there boolean").repartition("c", "k").sortWithinPartitions("c", "k", "pos")

    def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, until = None, None
        for batch in batches:
            hits = []
            for c, k, ms, there in zip(batch["c"], batch["k"], batch["ms"], batch["there"]):
                if (c, k) != unit:
                    unit, until = (c, k), None
                ms = None if ms is None or ms != ms else int(ms)
                hit = bool(there) and until is not None and (ms is None or ms <= until)
                if not hit:
                    until = None if ms is None else ms + ttl_ms
                hits.append(hit)
            yield pd.DataFrame({"c": batch["c"], "pos": batch["pos"], "cached": hits})

    done = timed.mapInPandas(live, "c string, pos long, cached boolean").select(F.col("c").alias(f"{c_}2"), F.col("pos").alias(f"{pos}2"), F.col("cached"))
    return rows.join(done, (rows[c_] == done[f"{c_}2"]) & (rows[pos] == done[f"{pos}2"])).select(*kept, "cached")
