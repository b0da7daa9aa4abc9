"""Tables to which every batch is added once, however often it is retried."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Sequence
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textweir.streaming.live import buffered

from .tables import AUDIT_SCHEMA, schema_of

#: Folder of the files that publish batches; readers of Parquet skip its name.
MANIFESTS = "_manifest"


class Files:
    """The file system of a path, whatever store that is."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.system = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def publish(self, name: str, text: str) -> bool:
        """Writes a file that appears whole or not at all; false if there is one already."""
        draft = f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}"
        out = self.system.create(self.path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.jvm.java.lang.reflect.Array.newInstance(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")._java_lang_class, 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri() if "://" in name else self.system.getUri(), self.conf)
        try:
            context.rename(self.system.makeQualified(self.path(draft)), self.system.makeQualified(self.path(name)), none)
        except Exception:
            self.delete(draft)
            if not self.exists(name):
                raise
            return False
        return True


def add_batch(rows: DataFrame, path: str, batch: int, source: str = "stream", partition_by: Sequence[str] = ("created_month",)) -> bool:
    """Adds a batch of a source to the table at `path`; false if it had been added before.

    Each attempt writes to a folder of its own, which counts only once a manifest names it. The
    first attempt that publishes one wins; what others wrote is deleted, or never read. So a
    batch that is retried after any failure is there once.
    """
    files, manifest = Files(rows.sparkSession, path), f"{path}/{MANIFESTS}/{source}-{batch}.json"
    if files.exists(manifest):
        return False
    folder = f"source={source}/batch={batch}/attempt={uuid.uuid4().hex}"
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    done = files.publish(manifest, json.dumps({"folder": folder, "rows": seen.get["rows"], "replaces": []}))
    if not done:
        files.delete(f"{path}/{folder}")
    return done


def manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """Manifests that count, by name: those that no later one replaces. One for each batch since
    the last compaction, so few."""
    folder = f"{path}/{MANIFESTS}"
    if not any(n.endswith(".json") for n in Files(spark, path).names(folder)):
        return {}
    said = spark.read.schema("folder string, rows long, replaces array<string>").option("pathGlobFilter", "*.json").json(folder)
    found = {r.name.rpartition("/")[2]: r.asDict() for r in said.withColumn("name", F.input_file_name()).collect()}
    gone = {name for m in found.values() for name in m["replaces"] or ()}
    return {name: m for name, m in found.items() if name not in gone}


def read_batches(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Rows of all batches that were published, and of no other attempt."""
    folders = sorted(m["folder"] for m in manifests(spark, path).values() if m["rows"])
    wanted = schema_of(schema)
    if not folders:
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders]).select(wanted.names)


def compact(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, partition_by: Sequence[str] = ("created_month",)) -> int:
    """Writes the published batches as one, sorted into few files, and publishes it in their place;
    returns how many there were. Their manifests stay, so a late retry still finds them; their
    folders are for vacuum() to delete, when no reader needs them any more."""
    held = manifests(spark, path)
    if len(held) > 1:
        folder = f"source=compacted/batch={len(held)}/attempt={uuid.uuid4().hex}"
        seen = Observation()
        rows = read_batches(spark, path, schema).observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.repartition(*partition_by).write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
        name = f"{path}/{MANIFESTS}/compacted-{uuid.uuid4().hex}.json"
        Files(spark, path).publish(name, json.dumps({"folder": folder, "rows": seen.get["rows"], "replaces": sorted(held)}))
    return len(held)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes folders of attempts that no manifest names, such as failed or compacted ones; not
    while batches are being added. Returns how many."""
    files, kept, gone = Files(spark, path), {m["folder"] for m in manifests(spark, path).values()}, 0
    for source in (n for n in files.names(path) if n.startswith("source=")):
        for batch in files.names(f"{path}/{source}"):
            for attempt in files.names(f"{path}/{source}/{batch}"):
                if f"{source}/{batch}/{attempt}" not in kept:
                    files.delete(f"{path}/{source}/{batch}/{attempt}")
                    gone += 1
    return gone


def batch_sink(path: str, source: str = "stream", partition_by: Sequence[str] = ("created_month",)) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that add_batch() keeps whole; `source` names the query, whose checkpoint
    numbers its batches."""

    def write(rows: DataFrame, batch: int) -> None:
        add_batch(rows, path, batch, source, partition_by)

    return write


def audit_lines() -> Column:
    """A line for each audit record: decision, agent, start of the hash, messages."""
    messages = F.transform(F.from_json("violations", "array<struct<message:string>>"), lambda v: v["message"])
    said = F.when(F.size(messages) > 0, F.concat(F.lit(" ["), F.array_join(messages, ", "), F.lit("]"))).otherwise("")
    return F.concat(F.rpad(F.upper("security_decision"), 5, " "), F.lit(" | agent="), F.coalesce("agent_id", F.lit("-")), F.lit(" | "), F.substring("input_hash", 1, 8), F.lit("..."), said)


def line_sink(out: TextIO | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of audit_lines(), to stderr by default; for development, since every line
    passes the driver, though one partition at a time."""

    def write(rows: DataFrame, _: int) -> None:
        for row in rows.select(audit_lines().alias("line")).toLocalIterator():
            print(row.line, file=out or sys.stderr)

    return write


def flush_audit(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", rows: int = 100, available_now: bool = False) -> StreamingQuery:
    """Hands a stream of audit records to a writer when a buffer holds `rows` or is `every` old,
    whichever comes first (A6). `available_now` takes what there is, unbuffered, and ends."""
    if available_now:
        return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    held = buffered(records, rows, pd.Timedelta(every).total_seconds())
    return held.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
