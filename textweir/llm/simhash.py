"""SimHash fingerprints and their links, found in sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

#: Fingerprints that one tree holds at most; bits of a routing key are chosen so that groups of
#: unrelated fingerprints stay well below it.
TREE, EXPECTED = 4096, 256
#: Bytes of shingle hashes counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64-bit SimHash, as a signed integer, of the shingles of a text's words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """64 bits, as a signed integer: those set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row. Null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fp": [fingerprint(t, shingle, seed) for t in batch["text"]]})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInPandas(run, f"id {kind}, fp long")
    return rows.withColumnRenamed("id", id_col)


def routes(radius: int, distinct: int) -> list[int]:
    """Masks of bits such that two fingerprints within `radius` agree on the bits of one at least.

    64 bits fall into radius + k blocks; at most radius of them differ, so k blocks agree. k grows
    until `distinct` random fingerprints leave EXPECTED in a group, at most.
    """
    k = 1
    while k < 4 and distinct >> (64 * k // (radius + k)) > EXPECTED:
        k += 1
    edges = [64 * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, k)]


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def near(self, value: int) -> list[int]:
        """Values within the radius: only edges within the radius of the distance are followed."""
        if self.root is None:
            return []
        found, todo, radius = [], [self.root], self.radius
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        at = self.root
        while True:
            d = (at[0] ^ value).bit_count()
            if not d:
                return
            child = at[1].get(d)
            if child is None:
                at[1][d] = (value, {})
                return
            at = child


def _links(radius: int):
    """For rows (route, grp, shard, role, fp) sorted by group and shard, trees before queries:
    links of each query to the nearest-to-root values of its tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, tree, leader = None, None, {}

        def top(x: int) -> int:
            while leader[x] != x:
                leader[x] = leader[leader[x]]
                x = leader[x]
            return x

        for batch in batches:
            a, b = [], []
            for key, role, fp in zip(zip(batch["route"], batch["grp"], batch["shard"]), batch["role"], batch["fp"]):
                if key != unit:
                    unit, tree, leader = key, BKTree(radius), {}
                value = fp & 0xFFFFFFFFFFFFFFFF
                near = tree.near(value)
                if role == 0:
                    tree.add(value)
                    leader[value] = value
                # One link for each set of values that is not linked yet, never all pairs.
                for root in {top(x) for x in near}:
                    a.append(fp)
                    b.append(root - (1 << 64) if root >> 63 else root)
                    if role == 0:
                        leader[root] = value
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def hamming_links(values: DataFrame, radius: int = 4, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect exactly what is connected by pairs of `fp` within the radius.

    `values` holds distinct fingerprints (fp long). Each goes to one group for every route; of a
    group, shards of about `tree` values are made into a BK-tree each, which the values of this
    and all later shards query: the shards of a large group are dealt to different tasks, so no
    tree holds a whole group. Links inside a shard are those that join sets not
    joined before; links from other shards are true links too.
    """
    distinct = values.count()
    masks = routes(radius, distinct)
    group = lambda m: F.xxhash64(F.lit(m - (1 << 64) if m >> 63 else m), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))
    keyed = values.select("fp", F.posexplode(F.array(*map(group, masks))).alias("route", "grp"))
    sizes = keyed.groupBy("route", "grp").agg(F.count("*").alias("n"))
    # Groups of one need no tree. Sizes are joined back only where a group is large.
    large = sizes.where(F.col("n") > tree).select("route", "grp", F.ceil(F.col("n") / tree).cast("int").alias("shards"))
    dealt = keyed.join(large, ["route", "grp"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    parts = (
        dealt.withColumn("own", own)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("own"))))
        .select("route", "grp", "shard", F.when(F.col("shard") == F.col("own"), 0).otherwise(1).alias("role"), "fp")
    )
    ordered = parts.repartition("route", "grp", "shard").sortWithinPartitions("route", "grp", "shard", "role", "fp")
    return ordered.mapInPandas(_links(radius), "a long, b long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42
) -> DataFrame:
    """Every row's SimHash (fp long) and component_id, the smallest id among the documents whose
    fingerprints are reached by links of at most `radius` differing bits.

    Shingles are of lower-cased (A-Z) words, repeats included; a text of fewer words is one
    shingle. Null and blank texts have fingerprint 0 and are linked like any other. Equal texts
    share a fingerprint and are counted once in the search. Rows that repeat are returned each.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle, seed))
    firsts = staged(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    joined = components(hamming_links(firsts.select("fp"), radius))
    named = firsts.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")
