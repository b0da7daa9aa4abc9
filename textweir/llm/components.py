"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links: the smallest node that can be reached.

    Alternates large stars and small stars: each node links its larger, then its smaller,
    neighbours to the smallest one it sees. Rounds are logarithmic in the nodes; each is two
    grouped minima, which Spark pre-aggregates, and joins that adaptive execution can split where
    a node has very many links. Null ends and loops are ignored.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = staged(pairs)
    if edges.isEmpty():
        return edges.selectExpr("u as node", "v as root")
    while True:
        large = staged(star(edges, larger=True))
        small = staged(star(large, larger=False))
        discard(large)
        same = large_is_small(edges, small)
        discard(edges)
        edges = small
        if same:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.selectExpr("u as node", "v as root").union(roots)


def large_is_small(before: DataFrame, after: DataFrame) -> bool:
    """Whether two sets of links are equal: by count and an order-free hash."""

    def digest(df: DataFrame):
        h = F.xxhash64("u", "v")
        return df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).head()

    return digest(before) == digest(after)


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star round over links u > v."""
    if larger:
        both = edges.select("u", "v").union(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        kept = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(least, "u")
        kept = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return kept.where("u > v").distinct()
