"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, staged

#: Neighbours of a node, reverse neighbours of a node that a join draws, and the share of new
#: neighbours in the graph under which joins end.
DEGREE, REVERSE, SETTLED = 32, 32, 0.02
#: Random trees that begin the graph and vectors of a leaf; the best partners that a vector keeps
#: from one leaf, and from one join.
TREES, LEAF, FIRST, PARTNERS = 6, 64, 16, 12
#: Of a search: nodes kept of a table of CROWD, nodes visited in its first round, the recall that a
#: sample of so many queries must show, and by how much wider the search is else.
KEPT, CROWD, EXPANDED, RECALL, SAMPLE, WIDER = 100, 10_000, 16, 0.93, 400, 1.5
#: Visits that are scored at once in a task, visits up to which they are broadcast, and rows of a
#: group that a task holds at most.
VISITS, FEW, LONG = 256, 200_000, 50_000
#: Products computed at once, and bytes of queries up to which they are broadcast.
CELLS, BROADCAST_BYTES = 2_000_000, 64 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part: neither null nor all zero, and without a
    component that is null or not finite."""
    each = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return each.where(~bad & F.exists("vec", lambda x: x != 0))


def packed(vectors: DataFrame) -> DataFrame:
    """(id, packed binary): components as 32-bit floats, for the joins only. All are divided by the
    largest of the table, which keeps every order and leaves none too large; shorter vectors are
    filled with zeros."""
    largest, size = vectors.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).head()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.zeros((len(batch), size), np.float32)
            for row, vec in zip(rows, batch["vec"]):
                row[: len(vec)] = np.asarray(vec) / largest
            yield pd.DataFrame({"id": batch["id"], "packed": [row.tobytes() for row in rows]})

    return vectors.mapInPandas(run, "id long, packed binary")


def matrix(points: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(points), np.float32).reshape(len(points), -1)


def by_group(df: DataFrame, key: str, act: Callable[[pd.DataFrame], pd.DataFrame], schema: str, again: bool = False) -> DataFrame:
    """`act` on blocks of whole groups of `key`, which stream through sorted partitions. With `again`,
    `act` also takes what it gives, and a long group is put through it in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = int(np.searchsorted(rows[key].to_numpy(), rows[key].iloc[-1])) if len(rows) else 0
            rest = rows.iloc[cut:]
            if again and len(rest) > LONG:
                rest = act(rest)
            if cut:
                yield act(rows.iloc[:cut])
        if rest is not None and len(rest):
            yield act(rest)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def slices(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bytes of each stretch of an array."""
    each, step = values.tobytes(), values.itemsize
    return [each[a * step : b * step] for a, b in zip(starts, np.append(starts[1:], len(values)))]


def leaves(points: DataFrame, n: int, seed: int) -> DataFrame:
    """(x, y): vectors y in the leaves x of TREES random trees, leaves of about LEAF vectors.

    A leaf is named by the sides of random planes; large leaves, such as those of many equal
    vectors, are divided by a hash of the id.
    """
    depth = max(0, ceil(log2(max(n, 1) / LEAF)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = matrix(batch["packed"])
            planes = np.random.default_rng(seed).standard_normal((points.shape[1], TREES, depth)).astype(np.float32)
            sides = np.einsum("nd,dtb->ntb", points, planes) > 0
            key = sides.astype(np.int64) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros((len(points), TREES), np.int64)
            key += np.arange(TREES, dtype=np.int64) << np.int64(depth)
            yield pd.DataFrame({"leaf": key.ravel(), "y": np.repeat(batch["id"].to_numpy(), TREES)})

    members = staged(points.mapInPandas(run, "leaf long, y long"))
    cuts = members.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).alias("cuts")).where("cuts > 1")
    cut = F.pmod(F.xxhash64("y", "leaf"), F.coalesce("cuts", F.lit(1)))
    return members.join(cuts, "leaf", "left").select(F.xxhash64("leaf", cut).alias("x"), "y")


#: Neighbours of a node in one row: EDGE for each; how many are fresh, and the product that others
#: must beat.
LISTS = "u long, edges binary, fresh long, least float"
EDGE = np.dtype([("v", "<i8"), ("s", "<f4"), ("fresh", "u1")])


def listed(u: np.ndarray, edges: np.ndarray, degree: int) -> pd.DataFrame:
    """Rows of LISTS from edges sorted by u and falling products."""
    starts = starts_of(u)
    last = np.append(starts[1:], len(u))
    least = np.where(last - starts >= degree, edges["s"][last - 1] if len(u) else 0, -np.inf).astype(np.float32)
    fresh = np.add.reduceat(edges["fresh"], starts, dtype=np.int64) if len(u) else starts
    return pd.DataFrame({"u": u[starts], "edges": slices(edges, starts), "fresh": fresh, "least": least})


def unlisted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of LISTS, and their edges."""
    return np.repeat(np.arange(len(rows)), [len(e) // EDGE.itemsize for e in rows["edges"]]), np.frombuffer(b"".join(rows["edges"]), EDGE)


def join_block(rows: pd.DataFrame, partners: int) -> pd.DataFrame:
    """Of rows (x, y, fresh, packed, least) sorted by x: for each y its best partners with the same
    x as a row of LISTS, of pairs with a fresh end and products above y's least."""
    x, ids = rows["x"].to_numpy(), rows["y"].to_numpy(np.int64)
    fresh, least, points = rows["fresh"].to_numpy(bool), rows["least"].to_numpy(np.float32), matrix(rows["packed"])
    starts = starts_of(x)
    sizes = np.diff(np.append(starts, len(x)))
    out = []
    a = 0
    while a < len(starts):
        wide = int(sizes[a : a + 32].max())
        some = min(32, max(1, CELLS // wide**2))
        s, n = starts[a : a + some], sizes[a : a + some]
        a += some
        wide = int(n.max())
        at = np.minimum(s[:, None] + np.arange(wide), len(x) - 1)
        real = np.arange(wide) < n[:, None]
        block = points[at]
        product = block @ block.transpose(0, 2, 1)
        new = fresh[at]
        allowed = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (product > least[at][:, :, None]) & ~np.eye(wide, dtype=bool)
        product[~allowed] = -np.inf
        if wide > partners:
            cut = np.partition(product, wide - partners, axis=2)[:, :, wide - partners, None]
            g, i, k = np.nonzero((product >= cut) & (product > -np.inf))
        else:
            g, i, k = np.nonzero(product > -np.inf)
        edges = np.ones(len(g), EDGE)
        edges["v"], edges["s"] = ids[at[g, k]], product[g, i, k]
        # Places, not ids, tell the rows apart: a node is in several lists.
        lists = listed(at[g, i], edges, len(ids))
        out.append(lists.assign(u=ids[lists["u"].to_numpy(np.int64)]))
    return pd.concat(out, ignore_index=True)


def joined(lists: DataFrame, partners: int) -> DataFrame:
    """Candidates as rows of LISTS from lists (x, y, fresh, packed, least): members of a list meet."""
    return by_group(lists.select("x", "y", "fresh", "packed", "least"), "x", lambda rows: join_block(rows, partners), LISTS)


def best(lists: DataFrame, degree: int) -> DataFrame:
    """The `degree` nearest neighbours of each node in a row; an edge found again is not fresh."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        place, edges = unlisted(rows)
        nodes = rows["u"].to_numpy(np.int64)
        firsts = starts_of(nodes)
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(nodes))))[place]
        order = by_two(group, edges["v"])
        group, edges = group[order], edges[order]
        once = starts_of(group, edges["v"])
        fresh = np.minimum.reduceat(edges["fresh"], once) if len(once) else edges["fresh"]
        group, edges = group[once], edges[once]
        edges["fresh"] = fresh
        # Products as whole numbers that fall as they rise.
        bits = np.ascontiguousarray(edges["s"]).view(np.int32).astype(np.int64)
        order = by_two(group, -np.where(bits < 0, -(bits & 0x7FFFFFFF), bits))
        starts = starts_of(group)
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        order = order[rank < degree]
        return listed(nodes[firsts][group[order]], edges[order], degree)

    return by_group(lists, "u", merge, LISTS, again=True)


def by_two(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by small whole numbers, then by others; by one sort where both fit in 64 bits."""
    if not len(first):
        return np.zeros(0, np.int64)
    low = int(second.min())
    bits = (int(second.max()) - low).bit_length()
    if bits + int(first.max()).bit_length() > 63:
        return np.lexsort((second, first))
    return np.argsort((first.astype(np.int64) << bits) | (second - low))


def edges_of(graph: DataFrame) -> DataFrame:
    """(u, v, fresh boolean) of rows of LISTS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, edges = unlisted(batch)
            yield pd.DataFrame({"u": batch["u"].to_numpy(np.int64)[place], "v": edges["v"], "fresh": edges["fresh"].astype(bool)})

    return graph.mapInPandas(run, "u long, v long, fresh boolean")


def settled(graph: DataFrame) -> DataFrame:
    """A graph without a fresh edge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, edges = unlisted(batch)
            edges = edges.copy()
            edges["fresh"] = 0
            yield batch.assign(edges=slices(edges, starts_of(place)), fresh=0)

    return graph.mapInPandas(run, LISTS)


def shares(x: np.ndarray, y: np.ndarray, turn: int) -> np.ndarray:
    """A draw from [0, 1) for each pair, by a hash."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)) / 2.0**53


def meetings(near: DataFrame, back: DataFrame, turn: int) -> DataFrame:
    """Lists (x, y, fresh) of what meets at x: its neighbours both ways, where one is fresh. As many
    old ones are drawn as there are fresh ones: pairs of old ones have met before."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, fresh = rows["x"].to_numpy(np.int64), rows["y"].to_numpy(np.int64), rows["fresh"].to_numpy(bool)
        order = np.lexsort((y, x))
        once = starts_of(x[order], y[order])
        fresh = np.maximum.reduceat(fresh[order], once)
        x, y = x[order][once], y[order][once]
        starts = starts_of(x)
        sizes = np.diff(np.append(starts, len(x)))
        new = np.add.reduceat(fresh, starts, dtype=np.int64)
        drawn = shares(x, y, turn) * np.repeat(sizes - new, sizes) < np.repeat(new, sizes)
        some = (fresh | drawn) & np.repeat(new > 0, sizes)
        return pd.DataFrame({"x": x[some], "y": y[some], "fresh": fresh[some]})

    return by_group(near.union(back), "x", draw, "x long, y long, fresh boolean")


def reversed_edges(graph: DataFrame, most: int, salt: int) -> DataFrame:
    """Edges of a graph turned round, for nodes that many point to a draw of `most`: ranks by a hash
    within a node, which Spark cuts before and after the shuffle."""
    drawn = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v", F.lit(salt))))
    return graph.withColumn("r", drawn).where(F.col("r") <= most).drop("r")


def nn_descent(points: DataFrame, degree: int = DEGREE, seed: int = 11) -> DataFrame:
    """Edges (u, v) to nearly the `degree` nearest neighbours by inner product of points (id, packed).

    Begins with the best partners in the small leaves of a few random trees. In a round, the
    neighbours and a draw of the reverse neighbours of each node meet (neighbours of neighbours),
    where one is fresh; pairs that beat what either has become candidates. Rounds go on until
    fewer than SETTLED of the edges are new; as edges only get better, they end. Lists are bounded
    by the degree and the draw.
    """
    n = points.count()
    none = F.lit(float("-inf")).cast("float")
    first = leaves(points, n, seed).join(points.withColumnRenamed("id", "y"), "y")
    graph = staged(best(joined(first.withColumns({"fresh": F.lit(True), "least": none}), FIRST), degree))
    for turn in count():
        known = points.withColumnRenamed("id", "y").join(graph.select(F.col("u").alias("y"), "least"), "y", "left").withColumn("least", F.coalesce("least", none))
        near = edges_of(graph)
        back = reversed_edges(near, REVERSE, turn).select(F.col("v").alias("x"), F.col("u").alias("y"), "fresh")
        lists = meetings(near.select(F.col("u").alias("x"), F.col("v").alias("y"), "fresh"), back, turn)
        after = staged(best(settled(graph).unionByName(joined(lists.join(known.hint("shuffle_hash"), "y"), PARTNERS)), degree))
        discard(graph)
        graph = after
        if graph.agg(F.coalesce(F.sum("fresh"), F.lit(0))).head()[0] <= SETTLED * degree * n:
            return edges_of(graph).select("u", "v")


def product(a: str, b: str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)


def coded(points: DataFrame) -> DataFrame:
    """(v, code binary): the largest component and each one's share of it in 127 steps, a byte each.
    By these a search finds its way; what it finds is compared by the original values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = matrix(batch["packed"]) if len(batch) else np.zeros((0, 1), np.float32)
            most = np.abs(rows).max(axis=1, keepdims=True)
            steps = np.rint(rows / np.where(most > 0, most, 1) * 127).astype(np.int8)
            codes = np.concatenate([most.view(np.uint8), steps.view(np.uint8)], axis=1)
            yield pd.DataFrame({"v": batch["id"], "code": [c.tobytes() for c in codes]})

    return points.mapInPandas(run, "v long, code binary")


def surroundings(links: DataFrame, points: DataFrame) -> DataFrame:
    """(u, ids binary, codes binary): all neighbours of a node in one row, so that a visit needs one
    join. Links of a node are bounded."""

    def packed_up(rows: pd.DataFrame) -> pd.DataFrame:
        u, ids = rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        starts = starts_of(u)
        return pd.DataFrame({"u": u[starts], "ids": slices(ids, starts), "codes": slices(codes.view(f"V{codes.shape[1]}").ravel(), starts)})

    coded_ = coded(points).hint("shuffle_hash")
    return by_group(links.join(coded_, "v").select("u", "v", "code"), "u", packed_up, "u long, ids binary, codes binary")


def visited(visits: DataFrame, around: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """(q, v, s float): neighbours of visited nodes with products above what the query keeps, from
    visits (q, u, least) and queries (q, a) with packed vectors. A few visits are broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), VISITS):
                rows = batch.iloc[at : at + VISITS]
                n = [len(x) // 8 for x in rows["ids"]]
                ids = np.frombuffer(b"".join(rows["ids"]), np.int64)
                codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(ids), -1)
                asked = np.repeat(matrix(rows["a"]), n, axis=0)
                s = np.einsum("ij,ij->i", codes[:, 4:].view(np.int8).astype(np.float32), asked)
                s *= np.ascontiguousarray(codes[:, :4]).view(np.float32).ravel() / 127
                q = np.repeat(rows["q"].to_numpy(), n)
                good = (s > np.repeat(rows["least"].to_numpy(np.float32), n)) & (ids != q)
                yield pd.DataFrame({"q": q[good], "v": ids[good], "s": s[good]})

    met = around.join(F.broadcast(visits), "u").join(asked, "q") if few else visits.join(asked, "q").join(around, "u")
    return met.select("q", "a", "least", "ids", "codes").mapInPandas(run, "q long, v long, s float")


def both_ways(graph: DataFrame) -> DataFrame:
    """Edges of a graph and a draw of DEGREE reverse ones for each node."""
    back = reversed_edges(graph, DEGREE, 0).select(F.col("v").alias("u"), F.col("u").alias("v"))
    return staged(graph.union(back).distinct())


def greedy_search(around: DataFrame, points: DataFrame, queries: DataFrame, kept: int) -> DataFrame:
    """(q, v): the `kept` nearest nodes found for each of `queries` (id), nodes of the graph.

    A search begins at the query's own node. In each round the best nodes not visited before give
    their neighbours `around`, both directions of the graph: EXPANDED of them at first, twice as
    many in each round up to 4 * EXPANDED or a quarter of what is kept. Of all nodes seen the best
    `kept` stay. It ends when all that a query keeps are visited.
    """
    asked = staged(points.join(queries.select("id"), "id").select(F.col("id").alias("q"), F.col("packed").alias("a")))
    known = broadcast_if_small(asked, "a")(asked)
    by_score = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    whole = by_score.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.coalesce(F.nth_value("s", kept).over(whole), F.lit(float("-inf"))).cast("float")
    waiting = F.sum(F.when(F.col("seen"), 0).otherwise(1)).over(by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    front = asked.select("q", F.col("q").alias("u"), F.lit(float("-inf")).cast("float").alias("least"))
    pool, ended, most, n = None, [], EXPANDED, asked.count()
    while n:
        fresh = visited(front, around, known, n <= FEW).withColumn("seen", F.lit(False))
        both = fresh if pool is None else fresh.unionByName(pool.where("active").select("q", "v", "s", (F.col("seen") | F.col("now")).alias("seen")))
        each = both.repartition("q").groupBy("q", "v").agg(F.max("s").alias("s"), F.max("seen").alias("seen"))
        ranked = each.withColumns({"r": F.row_number().over(by_score), "least": least, "waiting": waiting}).where(F.col("r") <= kept)
        marked = ranked.withColumn("now", ~F.col("seen") & (F.col("waiting") <= most)).withColumn("active", F.max("now").over(Window.partitionBy("q")))
        after = staged(marked.select("q", "v", "s", "seen", "least", "now", "active"))
        if pool is not None:
            discard(pool)
        pool, most = after, min(2 * most, max(4 * EXPANDED, kept // 4))
        n, over = pool.agg(F.count_if("now"), F.count_if(~F.col("active"))).head()
        if over:  # searches that have ended are set aside
            ended.append(staged(pool.where("not active").select("q", "v")))
        front = pool.where("now").select("q", F.col("v").alias("u"), "least")
    discard(asked)
    return reduce(DataFrame.union, ended) if ended else asked.select("q", F.col("q").alias("v")).limit(0)


def broadcast_if_small(df: DataFrame, col: str):
    """A function that marks tables of the rows of `df` for a broadcast, if these are small."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(col) + 32), F.lit(0))).head()[0]
    return F.broadcast if size <= BROADCAST_BYTES else lambda other: other


def compared(points: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """(q, v): the `k` nearest of all points for each of a bounded sample (q, a) of packed vectors.
    Blocks of points meet the sample, which goes to every task, and keep k for each query."""
    rows = sample.orderBy("q").collect()
    names, asked = np.array([r.q for r in rows], np.int64), matrix(pd.Series([bytes(r.a) for r in rows])) if rows else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if asked is None or not len(batch):
                continue
            ids = batch["id"].to_numpy()
            s = asked @ matrix(batch["packed"]).T
            s[names[:, None] == ids] = -np.inf
            near = np.argpartition(-s, min(k, len(ids)) - 1, axis=1)[:, :k]
            out = pd.DataFrame({"q": np.repeat(names, near.shape[1]), "v": ids[near].ravel(), "s": np.take_along_axis(s, near, 1).ravel()})
            yield out[out["s"] > -np.inf]

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))
    return points.mapInPandas(run, "q long, v long, s float").withColumn("r", rank).where(F.col("r") <= k).select("q", "v")


def search_width(around: DataFrame, points: DataFrame, asked: DataFrame, k: int, n: int) -> int:
    """How many nodes a search keeps: KEPT for CROWD nodes, growing with their number to the power
    of 0.6, and WIDER times as many until SAMPLE of the queries (all, if fewer, drawn by a hash)
    find RECALL of their `k` nearest by brute force, or all `n` are kept."""
    chosen = staged(asked.select("id").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE))
    vectors = points.join(F.broadcast(chosen), "id").select(F.col("id").alias("q"), F.col("packed").alias("a"))
    exact = staged(compared(points, vectors, k))
    total, kept = exact.count(), max(KEPT, int(KEPT * (n / CROWD) ** 0.6))
    while kept < n:
        hits = greedy_search(around, points, chosen, kept).join(exact, ["q", "v"]).count()
        if hits >= RECALL * total:
            break
        kept = int(kept * WIDER)
    discard(chosen, exact)
    return kept


def exact_scores(pool: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, v, score): the `k` nearest of each query's pool by original values in double precision,
    ties to the smaller id."""
    values = vectors.select(F.col("id").alias("v"), F.col("vec").alias("v_vec"))
    own = staged(vectors.join(queries.select("id"), "id").select(F.col("id").alias("q"), F.col("vec").alias("q_vec"), F.size("vec").alias("width")))
    bytes_ = own.agg(F.coalesce(F.sum(F.col("width") * 8 + 32), F.lit(0))).head()[0]
    own = F.broadcast(own.drop("width")) if bytes_ <= BROADCAST_BYTES else own.drop("width")
    exact = pool.select("q", "v").join(values, "v").join(own, "q").select("q", "v", product("q_vec", "v_vec").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    return exact.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found for each row whose id is divisible by
    `every`, nearest first, ties to the smaller id.

    All usable rows are indexed, equal vectors as one node: the smallest k + 1 ids of each stand
    for all, as no larger one can be among the nearest. Unusable vectors (see usable()) take no
    part, neither as queries; a vector with fewer components than another counts as filled with
    zeros. Of rows that share an id the vector that sorts first takes part. Fewer candidates than
    k give all of them. An empty table gives no rows; other columns are not read. How widely queries
    search is measured against brute force on a sample of them (see search_width()).
    """
    good = staged(usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    firsts = staged(good.withColumn("r", nth).where(F.col("r") <= k + 1))
    nodes = staged(firsts.where("r = 1").select("id", "vec"))
    members = firsts.select("id", "vec").join(nodes.withColumnRenamed("id", "node"), "vec").select("node", "id")
    queries = staged(good.where(F.col("id") % every == 0).join(nodes.withColumnRenamed("id", "node"), "vec").select("id", "node"))
    asked = staged(queries.select(F.col("node").alias("id")).distinct())
    points = staged(packed(nodes))
    n = points.count()
    graph = nn_descent(points)
    around = staged(surroundings(both_ways(graph), points))
    width = search_width(around, points, asked, k, n)
    found = exact_scores(greedy_search(around, points, asked, max(width, k)), nodes, asked, k)
    itself = nodes.join(asked, "id").select(F.col("id").alias("q"), F.col("id").alias("v"), product("vec", "vec").alias("score"))
    each = found.unionByName(itself).join(members.withColumnRenamed("node", "v"), "v")
    order = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    most = each.withColumn("r", order("q")).where(F.col("r") <= k + 1).select("q", "id", "score")
    answers = queries.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(most, "q").where("id <> query_id")
    return answers.withColumn("rank", order("query_id")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
