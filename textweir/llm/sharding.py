"""Contiguous minimax sharding of groups of equal texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Bits of the key in a first-level interval, and those that a refinement adds.
FIRST_BITS, MORE_BITS = 12, 6


@dataclass(frozen=True)
class Interval:
    """Groups whose keys share their leading `bits` bits, in key order."""

    bits: int
    prefix: int
    size: int
    groups: int

    @property
    def first_key(self) -> int:
        return self.prefix << (64 - self.bits)


def fill(sizes: Sequence[int], whole: Sequence[bool], capacity: int) -> list[tuple[int, int]]:
    """Greedy left-to-right filling: for each further shard, the interval it begins in and
    what of that interval went to the shard before (0 unless the interval may be divided)."""
    cuts, room = [], capacity
    for i, (size, atomic) in enumerate(zip(sizes, whole, strict=True)):
        if size <= room:
            room -= size
        elif atomic:
            cuts.append((i, 0))
            room = capacity - size
        else:
            taken = room
            while size - taken > 0:
                cuts.append((i, taken))
                step = min(capacity, size - taken)
                taken += step
                room = capacity - step
    return cuts


def least_capacity(sizes: Sequence[int], whole: Sequence[bool], shards: int) -> int:
    """Smallest capacity with which greedy filling needs at most `shards` shards."""
    total = sum(sizes)
    largest = max((s for s, w in zip(sizes, whole, strict=True) if w), default=0)
    low, high = max(largest, -(-total // shards), 1), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if len(fill(sizes, whole, mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """First keys of shards 1.. for a table (key long, size long) of distinct keys.

    The binary search runs over intervals of keys that are as coarse as the answer allows. A
    round reads the sizes of a few thousand intervals at most, gets an upper bound (an interval
    stays whole) and a lower one (an interval may be divided anywhere), and splits only
    intervals in which a cut can fall. It ends when both bounds agree, so the capacity is exact
    and no list of all groups reaches the driver.
    """

    def measure(df: DataFrame, bits: int) -> list[Interval]:
        prefix = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
        rows = df.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        return [Interval(bits, r.prefix, r["size"], r.n) for r in rows.collect()]

    intervals = measure(groups, FIRST_BITS)
    while intervals:
        intervals.sort(key=lambda x: x.first_key)
        sizes = [x.size for x in intervals]
        atomic = [x.groups == 1 for x in intervals]
        whole = [True] * len(intervals)
        high = least_capacity(sizes, whole, shards)
        low = least_capacity(sizes, atomic, shards)
        if low == high:
            return [intervals[i].first_key for i, _ in fill(sizes, whole, high)]
        early = [i for i, _ in fill(sizes, whole, low)]
        late = [i for i, _ in fill(sizes, atomic, high)]
        split = set()
        for j, at in enumerate(early[: shards - 1]):
            until = late[j] if j < len(late) else at
            split |= {i for i in range(min(at, until), max(at, until) + 1) if not atomic[i]}
        split = split or {i for i, a in enumerate(atomic) if not a}
        by_bits: dict[int, list[int]] = {}
        for i in split:
            by_bits.setdefault(intervals[i].bits, []).append(intervals[i].prefix)
        kept = [x for i, x in enumerate(intervals) if i not in split]
        for bits, prefixes in by_bits.items():
            inside = groups.where(F.shiftright("key", 64 - bits).isin(prefixes))
            kept += measure(inside, min(64, bits + MORE_BITS))
        intervals = kept
    return []


def minimax_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, cells: int = 256
) -> DataFrame:
    """Puts documents into `shards` contiguous ranges of text hashes of minimax size.

    Size is the UTF-8 bytes of the text plus 1 (null text: 1). Groups are equal texts; they are
    ordered by the 64-bit hash of the text and never divided. Null texts form one group. Equal
    rows are counted and placed each. An empty table gives an empty result. `cells` bounds the
    rows that one task numbers: each shard's rows are dealt to so many cells by document id.
    Returns id, size, text_crc32, key, shard and slot; other input columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text_col).alias("key"),
        )
    )
    groups = staged(base.groupBy("key").agg(F.sum("size").alias("size")))
    cuts = cut_keys(groups, shards)
    shard = sum((F.when(F.col("key") >= k, 1).otherwise(0) for k in cuts), F.lit(0)).cast("int")
    cell = F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int")
    placed = base.withColumns({"shard": shard, "cell": cell})
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    order = Window.partitionBy("shard", "cell").orderBy("id", "key")
    # At most shards * cells rows, whatever the input.
    return (
        placed.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["shard", "cell"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            "key",
            "shard",
            (F.col("start") + F.col("nth")).cast("long").alias("slot"),
        )
    )
