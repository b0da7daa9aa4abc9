"""Mixing sources to target weights through a tree, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.functions.names import fresh

from .common import staged, words

LEVELS = ("domain", "lang", "source")
#: Leaves up to which their table is broadcast; beyond, it is joined by key.
BROADCAST_LEAVES = 50_000
#: Hexadecimal digits of a document's draw that name its bucket in a leaf.
DIGITS = 3


def domain_of(source: Column) -> Column:
    """Default domain of a source: the number in its name, modulo four."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]+", 0)
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999")).cast("int") % 4, F.lit(0)).cast("string"))


def weight_of(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """Weight of a node by its name at a level; names without one weigh 1."""
    given = weights.get(level, {})
    if wrong := [name for name, weight in given.items() if not weight >= 0]:
        raise ValueError(f"weights are numbers from 0, but not those of {wrong}")
    out = F.lit(1.0)
    for name, weight in given.items():
        out = F.when(F.col(level) == name, float(weight)).otherwise(out)
    return out


def divide(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divides each parent's `budget` among its children by `weight`, none above its `room`.

    What a full child cannot take goes to its siblings by weight. Children in order of room per
    weight: the first ones that fill up get their room, the rest share what is left. A child
    without room, such as one of weight 0, is full from the start.
    """
    ratio = F.when(F.col("room") > 0, F.try_divide("room", "weight")).otherwise(0.0)
    order = Window.partitionBy(*parents).orderBy(ratio, name)
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide(F.col("budget") - F.col("before"), F.col("rest"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parents))
    return (
        nodes.withColumns({"before": before, "rest": rest})
        .withColumn("level", level)
        .withColumn("full", (F.col("room") == 0) | (F.col("level") >= ratio))
        .withColumn("budget", F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.col("weight") * shared))
        .drop("before", "rest", "level", "full", "weight", "room")
    )


def quotas(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Token budget of each leaf (columns LEVELS and room): top down, so a shortage below a node
    is first shared among its own children and reaches its siblings only as far as they cannot
    take it. The whole budget is `total`, or all room if that is less. A weight of 0 leaves a node
    and all below it no room, so a node whose children all have none passes its share on."""
    shut = F.lit(False)
    for level in LEVELS:
        shut = shut | (weight_of(level, weights) == 0)
    leaves = leaves.withColumn("room", F.when(shut, F.lit(0).cast(dict(leaves.dtypes)["room"])).otherwise(F.col("room")))
    root = leaves.agg(F.least(total.cast("double"), F.sum("room").cast("double")).alias("budget"))
    at, above = root, []
    for level in LEVELS:
        keys = [*above, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("room").alias("room")).withColumn("weight", weight_of(level, weights))
        if above:
            nodes = nodes.join(at, above)
        else:
            nodes = nodes.withColumn("one", F.lit(1)).join(F.broadcast(at.withColumn("one", F.lit(1))), "one").drop("one")
        at, above = divide(nodes, above, level), keys
    return at


def draw(seed: int, epoch: Column, id_col: str) -> Column:
    """Place of a document in the permutation of an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    share: float,
    weights: Mapping[str, Mapping[str, float]],
    epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
) -> DataFrame:
    """Selected documents with `copies`, their number of copies, beside all input columns.

    The budget is `share` times all tokens (white-space words, at least 1 a document). It goes
    down the tree domain, lang, source by weights; a leaf holds at most `epochs` times its tokens
    and what it cannot take is redistributed among siblings before ancestors. A leaf takes whole
    epochs and of the last one the longest prefix of documents, in the order of a seeded hash,
    that its budget holds; so a copy count is the epochs a document is in. A node of weight 0 is
    left out, negative weights are refused. Null names are the
    name ''. A null text has one token. Rows that repeat are documents each, in order of their
    texts' hash. An empty table gives an empty result. Added columns: domain, tokens, copies;
    input columns of these names are replaced.
    """
    lang, source, whole, rest, drawn_, bucket, end, left, sum_ = fresh(docs, "_lang", "_source", "_whole", "_rest", "_draw", "_bucket", "_end", "_left", "_sum")
    names = {
        "domain": domain_of(F.col("source")) if domain is None else domain,
        lang: F.coalesce("lang", F.lit("")),
        source: F.coalesce("source", F.lit("")),
        "tokens": F.greatest(F.size(words(F.col(text_col))), F.lit(1)).cast("long"),
    }
    named = docs.withColumns(names)
    keys = [F.col("domain"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    sizes = staged(named.groupBy(*keys).agg(F.sum("tokens").alias("held")))
    leaves = sizes.withColumn("room", F.col("held") * epochs)
    total = F.floor(F.sum("held") * F.lit(share))
    budget = quotas(leaves.select(*LEVELS, "room", "held"), total, weights)
    quota = F.floor(F.col("budget") + 1e-6).cast("long")
    times = F.floor(quota / F.col("held")).cast("long")
    by = ["domain", lang, source]
    plan = sizes.join(budget, list(LEVELS)).select(
        "domain", F.col("lang").alias(lang), F.col("source").alias(source), times.alias(whole), (quota - times * F.col("held")).alias(rest)
    )
    plan = staged(plan)
    small = lambda df: F.broadcast(df) if plan.count() <= BROADCAST_LEAVES else df
    drawn = lambda df: df.withColumn(drawn_, draw(seed, F.col(whole), id_col)).withColumn(bucket, F.substring(drawn_, 1, DIGITS))
    # Where the prefix of the last epoch ends: the bucket, and the tokens left for it.
    per_bucket = drawn(named.join(small(plan), by)).groupBy(*by, rest, bucket).agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy(*by).orderBy(bucket)
    ends = (
        per_bucket.withColumn("upto", F.sum("n").over(upto))
        .where(F.col("upto") > F.col(rest))
        .groupBy(*by)
        .agg(F.min(F.struct(F.col(bucket).alias("bucket"), (F.col(rest) - F.col("upto") + F.col("n")).alias("left"))).alias("end"))
        .select(*by, F.col("end.bucket").alias(end), F.col("end.left").alias(left))
    )
    plan = staged(plan.join(ends, by, "left").drop(rest))
    placed = drawn(named.join(small(plan), by))
    inside = F.col(bucket) < F.col(end)
    clear = placed.where(F.col(end).isNull() | (F.col(bucket) != F.col(end))).withColumn("copies", F.col(whole) + F.when(inside, 1).otherwise(0))
    order = Window.partitionBy(*by).orderBy(drawn_, id_col, F.xxhash64(text_col))
    edge = (
        placed.where(F.col(bucket) == F.col(end))
        .withColumn(sum_, F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("copies", F.col(whole) + F.when(F.col(sum_) <= F.col(left), 1).otherwise(0))
        .drop(sum_)
    )
    chosen = clear.unionByName(edge).where("copies > 0")
    return chosen.drop(lang, source, drawn_, bucket, end, left, whole)
