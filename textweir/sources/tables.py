"""Readers and sinks (A6-A14, sources)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AUDIT_SCHEMA = "id string, timestamp timestamp, session_id string, agent_id string, user_id_hash string, request_type string, input_hash string, input_token_count bigint, model string, security_decision string, security_reason string, violations string, created_month date"
COST_SCHEMA = "entity_id string, model string, input_tokens bigint, output_tokens bigint, cost decimal(10,6), timestamp timestamp"
PIN_SCHEMA = "server_id string, tools_hash string, tool_count int, known_tools array<string>, pinned_at timestamp"


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def local(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds, whose size the optimizer knows: joins broadcast it while
    it is small. A table made from a list of rows counts as huge, so the other side would move."""
    names = schema_of(schema).names
    return spark.createDataFrame(pa.table({name: [row[i] for row in rows] for i, name in enumerate(names)}), schema)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where an input has fewer files or blocks than that: pattern
    matching costs far more than the shuffle. Large inputs stay as they are read."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def write_audit(records: DataFrame, path: str) -> None:
    """Appends audit records, one folder a month, so that retention and time filters prune."""
    records.write.mode("append").partitionBy("created_month").parquet(path)


def console_sink(batch: DataFrame, _: int) -> None:
    """foreachBatch writer that shows decisions by count, never the records."""
    batch.groupBy("created_month", "request_type", "security_decision").count().orderBy("created_month").show(truncate=False)


def memory_sink(spark: SparkSession, name: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that appends to a table of the session's catalog, for tests."""
    return lambda batch, _: batch.write.mode("append").saveAsTable(name)


def write_audit_by(records: DataFrame, path: str, column: str, buckets: int = 64) -> None:
    """Appends records laid out for look-ups by session, agent or decision (A11): by month and a hash
    bucket of the column, sorted by it, so that min and max of row groups prune."""
    laid = records.withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
    laid.repartition("created_month", "bucket").sortWithinPartitions("created_month", "bucket", column).write.mode("append").partitionBy("created_month", "bucket").parquet(path)


def read_audit_by(spark: SparkSession, path: str, column: str, value: str, buckets: int = 64) -> DataFrame:
    """Records with a value of the column that write_audit_by() laid them out by."""
    bucket = F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int")
    return spark.read.schema(f"{AUDIT_SCHEMA}, bucket int").parquet(path).where((F.col("bucket") == bucket) & (F.col(column) == value)).drop("bucket")


def write_costs(records: DataFrame, path: str) -> None:
    """Appends (entity_id, model, input_tokens, output_tokens, cost, ts) as the cost table, by day."""
    row = records.withColumn("timestamp", F.col("ts")).select(*[F.col(f.name).cast(f.dataType) for f in schema_of(COST_SCHEMA)])
    row.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def write_pins(pins: DataFrame, path: str, pinned_at: Column | None = None) -> None:
    """Appends pins with their time, now by default (A13): the table is their history, of which
    pins_as_of() finds the pin of a time and latest_pins() the present ones."""
    row = pins.withColumn("pinned_at", F.current_timestamp() if pinned_at is None else pinned_at)
    row.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(PIN_SCHEMA)]).write.mode("append").parquet(path)


def latest_pins(history: DataFrame) -> DataFrame:
    """The last pin of each server."""
    columns = [c for c in history.columns if c != "server_id"]
    last = F.max_by(F.struct(*columns), F.struct("pinned_at", "known_tools"))
    return history.groupBy("server_id").agg(last.alias("pin")).select("server_id", *[F.col("pin")[c].alias(c) for c in columns])


#: Columns of which every row group keeps a Bloom filter, for look-ups of single values.
LOOKED_UP = ("session_id", "agent_id", "id")


def write_searchable(records: DataFrame, path: str, columns: Sequence[str] = LOOKED_UP, rows: int = 1_000_000) -> None:
    """Appends audit records by month, with Bloom filters on the columns that look-ups name, so that
    row groups without a value are not read whatever the order of the rows."""
    writer = records.write.mode("append").partitionBy("created_month").option("maxRecordsPerFile", rows)
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    writer.parquet(path)


VIOLATION_INDEX = "violation_type string, day date, id string, created_month date"


def violation_index(records: DataFrame) -> DataFrame:
    """(violation_type, day, id, created_month): a row for each kind of violation of each audit record
    that has one, the inverted index of the violations column (A11)."""
    types = F.array_distinct(F.transform(F.from_json("violations", "array<struct<type:string>>"), lambda v: v["type"]))
    return records.select(F.explode(types).alias("violation_type"), F.to_date("timestamp").alias("day"), "id", "created_month")


def write_violation_index(records: DataFrame, path: str) -> None:
    """Appends the index of records by type and month, in order of days: a look-up reads the files of
    its type and months, and of those the row groups of its days."""
    rows = violation_index(records)
    rows.repartition("violation_type", "created_month", "day").sortWithinPartitions("violation_type", "created_month", "day").write.mode("append").partitionBy("violation_type", "created_month").parquet(path)


def with_violation(records: DataFrame, index: DataFrame, violation_type: str, first: date, last: date) -> DataFrame:
    """Audit records with a violation of a type on days from first to last, by way of the index:
    months of records without one are not read."""
    found = index.where((F.col("violation_type") == violation_type) & F.col("day").between(first, last) & F.col("created_month").between(first.replace(day=1), last))
    months = [r[0] for r in found.select("created_month").distinct().collect()]  # of the days asked for
    return records.where(F.col("created_month").isin(months)).join(found.select("id").distinct(), "id", "left_semi")


def schema_of(text: str) -> StructType:
    return StructType.fromDDL(text)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def retained(records: DataFrame, today: date, days: int) -> DataFrame:
    """Records of months that end within the retention (A14, an extension); prunes partitions."""
    return records.where(F.add_months("created_month", 1) > F.date_sub(F.lit(today), days))
