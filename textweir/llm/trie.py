"""The trie of conversation prefixes: parallel tree contraction by rounds of joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, staged

#: Rows of a conversation, or conversations of an end, that one task takes together (as bits).
CELL_BITS = 12
#: Re-expansions between two written tables, so that plans stay short.
STEPS = 3
LANES = ("_s0", "_s1", "_s2", "_s3")
#: Key of the root.
ROOT = b""


def running_sums(rows: DataFrame, key: str, cell: Column, order: str, values: Sequence[str]) -> DataFrame:
    """Adds to each of `values` those of earlier rows of the same key. `cell` grows with `order`:
    totals of cells are summed in order, rows only within their cell, so a busy key is spread."""
    celled = rows.withColumn("_cell", cell)
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy(key, "_cell").agg(*[F.sum(v).alias(v) for v in values])
    before = totals.select(key, "_cell", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before{v}") for v in values])
    inside = Window.partitionBy(key, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = celled.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, [key, "_cell"])
    return summed.withColumns({v: F.col(v) + F.col(f"_before{v}") for v in values}).drop("_cell", *[f"_before{v}" for v in values])


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, bytes): every turn's place in its conversation, from 1, by turn (null
    first) and then by the digest of role and text; texts themselves do not move."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said[1]).cast("long").alias("bytes"), F.lit(1).cast("long").alias("pos")
    )
    keys = ["conv", "turn", "digest"]
    ordered = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("turn").withColumn("at", F.monotonically_increasing_id()))
    return running_sums(ordered, "conv", F.shiftright("at", CELL_BITS), "at", ["pos"]).drop("at")


def rebuilt(turns: DataFrame, most: int = 8, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their family: (conv, depth, digest,
    bytes, last) for every turn, and (conv, total) for every conversation.

    `turns` are those of numbered_turns(). Conversation c takes the first h = crc32(c) mod
    (most + 1) turns of c - c mod family, then its own after its first h.
    """
    base = F.col("conv") - F.col("conv") % family
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("turns"))
    first = sizes.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = sizes.withColumns({"base": base, "h": h}).join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = staged(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("total")))
    own = turns.join(convs, "conv").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    # At most `most` rows of each family's first, for its few members.
    heads = turns.where((F.col("conv") == base) & (F.col("pos") <= most)).withColumnRenamed("conv", "base")
    shared = convs.join(heads, "base").where("pos <= h").withColumn("depth", F.col("pos"))
    columns = ["conv", "depth", "digest", "bytes", (F.col("depth") == F.col("total")).alias("last")]
    return own.select(columns).union(shared.select(columns)), convs.select("conv", "total")


def paths(rows: DataFrame) -> DataFrame:
    """(conv, key, parent, depth, bytes, last): the node that each turn leads to. A node's key is a
    digest of sums over its turns' digests, each with its depth, so sums run in any grouping."""
    placed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    lanes = rows.withColumn("_hash", placed).withColumns({v: F.conv(F.substring("_hash", 1 + 8 * i, 8), 16, 10).cast("long") for i, v in enumerate(LANES)})
    own = lanes.withColumns({f"_own{v}": F.col(v) for v in LANES})
    summed = running_sums(own.drop("_hash", "digest"), "conv", F.shiftright("depth", CELL_BITS), "depth", LANES)
    key = lambda depth, sums: F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))
    parent = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(key(F.col("depth") - 1, [F.col(v) - F.col(f"_own{v}") for v in LANES]))
    return summed.select("conv", key(F.col("depth"), map(F.col, LANES)).alias("key"), parent.alias("parent"), "depth", "bytes", "last")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv): the ids that end at a node, ascending and joined by commas.
    Ids are joined by ranges first; the hash runs over a node's ranges in order and holds one."""
    ranges = ends.groupBy("key", F.shiftright("conv", CELL_BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    ordered = ranges.repartition("key").sortWithinPartitions("key", "range")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, ids in zip(batch["key"], batch["ids"]):
                if last is not None and key != last:
                    done.append((last, digest.hexdigest()))
                    digest = hashlib.sha256()
                elif key == last:
                    digest.update(b",")
                digest.update(ids.encode())
                last = key
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, digest.hexdigest())], columns=["key", "ends_sha256"])

    return ordered.mapInPandas(run, "key binary, ends_sha256 string")


def contract(tree: DataFrame, values: Sequence[str]) -> list[DataFrame]:
    """Rounds of a table (id, parent, depth, *values) of one tree, each with the rows that were left
    and their `kind`: leaves are raked, their values go to the parent; of unary chains every node
    whose depth is less divisible by two than its neighbours' is spliced out, its values go to the
    parent and its child there too. The rest is live, until only the root is.
    """
    rounds = []
    live = tree.select("id", "parent", "depth", *values)
    while True:
        kids = live.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("degree"), F.min("id").alias("only"))
        known = live.join(kids, "id", "left")
        rank = F.struct(F.col("depth").bitwiseAND(-F.col("depth")).alias("bit"), "depth")
        inner = F.col("parent").isNotNull()
        leaf, unary = inner & F.col("degree").isNull(), inner & (F.col("degree") == 1)
        said = lambda to, own, given: F.struct(F.col(to).alias("id"), (rank if own else F.lit(None).cast("struct<bit:bigint,depth:bigint>")).alias("least"), F.lit(given).alias("raked"), *[(F.col(v) if given else F.lit(0)).cast("long").alias(f"_{v}") for v in values])
        told = F.when(leaf, F.array(said("parent", False, 1))).when(unary, F.array(said("parent", True, 0), said("only", True, 0)))
        heard = known.select(F.inline(told)).groupBy("id").agg(F.min("least").alias("least"), F.sum("raked").alias("raked"), *[F.sum(f"_{v}").alias(f"_{v}") for v in values])
        both = known.join(heard, "id", "left")
        alone = F.col("least").isNull() | (rank < F.col("least"))
        kind = F.when(leaf, "leaf").when(unary & (F.coalesce("raked", F.lit(0)) == 0) & alone, "chain").otherwise("live")
        marked = both.select("id", "parent", "depth", "only", kind.alias("kind"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        up = lambda to, parent, given: F.struct(F.col(to).alias("id"), parent.alias("_up"), *[(F.col(v) if given else F.lit(0)).cast("long").alias(f"_{v}") for v in values])
        spliced = marked.where("kind = 'chain'").select(F.inline(F.array(up("parent", F.lit(None).cast("binary"), True), up("only", F.col("parent"), False))))
        moved = spliced.groupBy("id").agg(F.max("_up").alias("_up"), *[F.sum(f"_{v}").alias(f"_{v}") for v in values])
        after = marked.join(moved, "id", "left")
        done = staged(after.select("id", F.coalesce("_up", "parent").alias("parent"), "depth", "only", "kind", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))
        rounds.append(done)
        live = done.where("kind = 'live'").select("id", "parent", "depth", *values)
        if live.where("parent is not null").limit(1).count() == 0:
            return rounds


def expanded(rounds: Sequence[DataFrame], values: Sequence[str]) -> DataFrame:
    """(id, *values): totals over subtrees. Rounds are undone from the last: a raked leaf had its
    total, a spliced node's is its own and that of the node that was its child."""
    total = rounds[-1].where("kind = 'live'").select("id", *values)
    written = None
    for i, done in enumerate(reversed(rounds), 1):
        chain = done.where("kind = 'chain'").select(F.col("only").alias("id"), F.struct("id", *values).alias("spliced"))
        each = F.array_compact(F.array(F.struct("id", *values), F.when(F.col("spliced").isNotNull(), F.struct(F.col("spliced.id").alias("id"), *[(F.col(v) + F.col(f"spliced.{v}")).alias(v) for v in values]))))
        total = total.join(chain, "id", "left").select(F.inline(each)).union(done.where("kind = 'leaf'").select("id", *values))
        if i % STEPS == 0 and i < len(rounds):
            total, old = staged(total), written
            written = total
            if old is not None:
                discard(old)
    return total


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A null role or text counts as empty. Turns with the same number follow their digests, rows
    that repeat are turns each. Rows without a conversation id belong to none and are left out;
    without any conversation there is no node. Other columns are not read. A conversation, a node's
    members and a node's children may be any share of the input.
    """
    turns = numbered_turns(conversations, conv, turn, role, text)
    rows, convs = rebuilt(turns)
    steps = staged(paths(rows))
    whole = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    inner = steps.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("parent", "depth", "bytes")])
    none = F.lit(0).cast("long")
    top = whole.select(F.lit(ROOT).alias("key"), "conv", "n_convs", F.lit(None).cast("binary").alias("parent"), none.alias("depth"), none.alias("bytes"))
    nodes = staged(inner.union(top.select(inner.columns)))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    tree = staged(
        nodes.join(kids, "key", "left").select(
            F.col("key").alias("id"), "parent", "conv", "depth", "n_convs", F.coalesce("n_children", none).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
        )
    )
    values = ["n_leaves", "saved_tokens"]
    rounds = contract(tree, values)
    ends = steps.where("last").select("key", "conv").union(convs.where("total = 0").select(F.lit(ROOT).alias("key"), "conv"))
    hashes = end_digests(ends).withColumnRenamed("key", "id")
    # The root may have any number of children; its smallest member is one number.
    smallest = convs.agg(F.min("conv")).head()[0]
    above = nodes.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    deep = tree.where("depth > 1").join(above, "parent", "left")
    flat = tree.where("depth <= 1").withColumn("parent_conv", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")))
    columns = ["id", "conv", "depth", "parent_conv", "n_convs", "n_children"]
    return (
        deep.select(columns).union(flat.select(columns)).join(expanded(rounds, values), "id").join(hashes, "id", "left")
        .select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", *values, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )
