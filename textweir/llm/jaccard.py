"""Classes of documents whose sets of shingles have a Jaccard similarity of 0.8 or more, confirmed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, words
from .components import components
from .passages import gram_hashes, mixed, signed, word_hashes
from .simhash import hamming_links, majority

#: Words of a shingle. Texts are near copies from a similarity of LEAST[0] / LEAST[1].
SHINGLE, LEAST = 5, (4, 5)
#: Differing bits up to which SimHash fingerprints of shingles are linked.
RADIUS = 8
#: Least hashes by bands: a pair at 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 40, about 1e-7.
BANDS, ROWS = 40, 5
#: Equal least hashes below which a pair is not confirmed: at 0.8 fewer have a chance below 1e-13.
LIKELY = 110
#: Texts and bytes of text in a shard of a block, about; nodes up to which they are broadcast.
SHARD, SHARD_BYTES, BROADCAST = 2048, 8 << 20, 100_000
#: Hashes multiplied at once.
STEP = 512
SEEDS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_key(text: Column) -> Column:
    """Names a lower-cased (A-Z) word sequence: 64 bits."""
    return F.xxhash64(F.array_join(words(F.translate(text, LETTERS, LETTERS.lower())), " "))


def shingles(text: str | None) -> np.ndarray:
    """Hashes, ascending and distinct, of the runs of five lower-cased words; a text of fewer is one run."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(gram_hashes(hashes, min(SHINGLE, max(len(hashes), 1))))


def signature(values: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the seeds."""
    least = np.full(len(SEEDS), ~np.uint64(0))
    for i in range(0, len(values), STEP):
        least = np.minimum(least, (values[i : i + STEP, None] * SEEDS).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the exact Jaccard similarity of two sets reaches LEAST."""
    part, whole = LEAST
    if part * max(len(a), len(b)) > whole * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def routes(rows: DataFrame) -> DataFrame:
    """(id, key, fp long, routes array<long>) from (id, key, text): the SimHash of the shingles, and
    one route for each band, none without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            found, prints = [], []
            for text in batch["text"]:
                values = shingles(text)
                route = mixed(band + np.uint64(1))
                for part in signature(values).reshape(BANDS, ROWS).T:
                    route = mixed(route + part.astype(np.uint64))
                found.append(signed(route) if len(values) else np.zeros(0, np.int64))
                prints.append(majority(values))
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "fp": prints, "routes": found})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(run, f"id {kind}, key long, fp long, routes array<long>")


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For rows (root, shard, role, node, text) sorted by root, shard and role, members before
    queries: links of each text to one member of each set that it is similar to and not yet in."""
    unit = None

    def top(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    for batch in batches:
        a, b = [], []
        for key, role, node, text in zip(zip(batch["root"], batch["shard"]), batch["role"], batch["node"], batch["text"]):
            if key != unit:
                unit, sets, nodes, leader = key, [], [], []
                prints = np.zeros((64, len(SEEDS)), np.uint32)
            values = shingles(text)
            own, n = signature(values), len(sets)
            equal = (prints[:n] == own).sum(1)
            likely = np.flatnonzero(equal >= LIKELY)
            linked = set()
            for i in likely[np.argsort(-equal[likely], kind="stable")].tolist():
                if (root := top(i)) not in linked and similar(values, sets[i]):
                    linked.add(root)
                    a.append(node)
                    b.append(nodes[i])
            if role == 0:
                if n == len(prints):
                    prints = np.concatenate([prints, np.zeros_like(prints)])
                prints[n] = own
                sets.append(values)
                nodes.append(node)
                leader.append(n)
                for root in linked:
                    leader[root] = n
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def print_links(firsts: DataFrame) -> DataFrame:
    """Links (a, b) of keys whose fingerprints are connected by at most RADIUS differing bits, as BK-trees find them."""
    prints = firsts.where(F.size("routes") > 0).select("key", "fp")
    joined = components(hamming_links(staged(prints.select("fp").distinct()), RADIUS))
    named = prints.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least")
    return named.join(least, "root").where("key <> least").selectExpr("key as a", "least as b")


def band_links(firsts: DataFrame) -> DataFrame:
    """Links (a, b) of keys that share a band."""
    keyed = firsts.select("key", F.explode("routes").alias("route"))
    least = keyed.groupBy("route").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select("route", "least")
    return keyed.join(least, "route").where("key <> least").selectExpr("key as a", "least as b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, and (key, first, root) of every distinct text: the smallest id that
    has it and the name of its class, which joins what pairs of LEAST or more connect.

    Texts with near fingerprints are joined to blocks. A radius loses links, so texts that share a
    band are joined too; then the blocks hold every pair but for the chance at BANDS. The texts of a block go to its shards once, and shards query those after them, so no
    task holds a whole block; exact similarity decides, and only pairs that join sets are linked.
    """
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = staged(routes(source))
    firsts = staged(rows.groupBy("key").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("routes").alias("routes")))
    blocks = staged(components(print_links(firsts).union(band_links(firsts))))
    near = F.broadcast(blocks) if blocks.count() <= BROADCAST else blocks
    texts = staged(source.select(F.col("key").alias("node"), "text").join(near, "node").groupBy("root", "node").agg(F.first("text").alias("text")))
    sizes = texts.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.select("root", F.ceil(F.greatest(F.col("n") / SHARD, F.col("bytes") / SHARD_BYTES)).cast("int").alias("shards")).where("shards > 1")
    dealt = texts.join(large, "root", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    parts = (
        dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("own"))))
        .select("root", "shard", F.when(F.col("shard") == F.col("own"), 0).otherwise(1).alias("role"), "node", "text")
    )
    ordered = parts.repartition("root", "shard").sortWithinPartitions("root", "shard", "role", "node")
    joined = components(ordered.mapInPandas(_links, "a long, b long"))
    discard(texts, blocks)
    named = firsts.drop("fp", "routes").join(joined.select(F.col("node").alias("key"), "root"), "key", "left")
    return rows.select("id", "key"), staged(named.withColumn("root", F.coalesce("root", "key")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's component_id: the smallest id of its class. Texts without words are one class.
    Rows that repeat are returned each."""
    rows, named = classes(docs, id_col, text_col)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("key", "component_id"), "key").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: that with the smallest id, of several the least."""
    _, named = classes(docs, id_col, text_col)
    chosen = named.groupBy("root").agg(F.min(F.struct("first", "key")).alias("c")).select(F.col("c.key").alias("_key"), F.col("c.first").alias("_id"))
    rows = docs.withColumn("_key", text_key(F.col(text_col)))
    found = rows.join(chosen, (rows["_key"] == chosen["_key"]) & (rows[id_col] == chosen["_id"])).select(rows["_key"], *[rows[c] for c in docs.columns])
    return found.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
