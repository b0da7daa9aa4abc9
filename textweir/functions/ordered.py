"""Values that depend on all earlier rows of a key, in two levels: cells of an order, and rows within
their cell. So a key that holds a large part of a table is spread over its cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import fresh

#: Width of a cell where an order is by numbers.
WIDTH = 4096
#: Rows up to which the running sum of a key is taken in one task.
ONE_CELL = 1_000_000


def cell(df: DataFrame, order: str, chunk: str = "hour") -> Column:
    """The cell of an order column: the hour (or other chunk) of times, ranges of numbers."""
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp") or kind == "date":
        return F.date_trunc(chunk, F.col(order))
    return F.floor(F.col(order).cast("double") / WIDTH)


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def with_totals(df: DataFrame, keys: Sequence[str], cut: str, totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with columns of its cells' rows in `totals`; null keys and cells meet as well."""
    other = fresh(df, *[f"_{k}_of_cell" for k in (*keys, cut)])
    named = totals.select(*[F.col(k).alias(n) for k, n in zip((*keys, cut), other)], *columns)
    return df.join(named, same(df, named, list(zip((*keys, cut), other)))).drop(*other)


def running_total(df: DataFrame, keys: list[str], at: str, tie: str, value: str, out: str, chunk: str = "hour", one_cell: int = ONE_CELL) -> DataFrame:
    """Adds the sum of `value` over earlier rows of the same keys, by `at` and `tie`; null values
    count 0, null keys are keys. Keys with up to `one_cell` rows are one cell: their doubles are added
    in this order, so that sums have the same last bits as those of a plain loop."""
    _, cut, sum_, before, inside, n, *other = fresh(df, out, "_chunk", "_sum", "_before", "_inside", "_n", *[f"_{k}_of_large" for k in keys])
    large = df.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > one_cell).select(*[F.col(k).alias(o) for k, o in zip(keys, other)], n)
    sized = df.join(large, same(df, large, list(zip(keys, other))), "left").drop(*other)
    celled = sized.withColumn(cut, F.when(F.col(n).isNotNull(), cell(df, at, chunk))).drop(n)
    earlier = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy(*keys, cut).agg(F.sum(value).alias(sum_)).withColumn(before, F.coalesce(F.sum(sum_).over(earlier), F.lit(0.0)))
    within = Window.partitionBy(*keys, cut).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = celled.withColumn(inside, F.coalesce(F.sum(value).over(within), F.lit(0.0)))
    joined = with_totals(placed, keys, cut, totals, [before])
    return joined.withColumn(out, F.col(before) + F.col(inside)).drop(cut, before, inside)


def numbered(df: DataFrame, keys: list[str], at: str, tie: str, out: str, chunk: str = "hour") -> DataFrame:
    """Adds the place of each row among those of its keys, from 0, by `at` and `tie`."""
    _, cut, n, before, inside = fresh(df, out, "_chunk", "_n", "_before", "_inside")
    celled = df.withColumn(cut, cell(df, at, chunk))
    earlier = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy(*keys, cut).agg(F.count("*").alias(n)).withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    placed = celled.withColumn(inside, F.row_number().over(Window.partitionBy(*keys, cut).orderBy(at, tie)) - 1)
    joined = with_totals(placed, keys, cut, totals, [before])
    return joined.withColumn(out, (F.col(before) + F.col(inside)).cast("long")).drop(cut, before, inside)
