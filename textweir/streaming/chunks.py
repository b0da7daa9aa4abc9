"""Streams of response chunks, budgets and screening."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textweir.operators.chain import ScanConfig, scan
from textweir.operators.cost import bucket, cost

from .live import reassemble_stream as reassemble_stream


def reassemble(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Whole texts from chunks in a table, in order; null texts add nothing (R1, R3). The last
    non-null usage wins (R4), and the last value of the columns to `keep`."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.coalesce(text, F.lit("")).alias("text"))))
    usage = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in ("in_tok", "out_tok", *keep) if c in chunks.columns]
    return chunks.groupBy(F.col(stream).alias("stream_id")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.count("*").alias("n_chunks"), *usage)


def finish(streams: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """What the end of a stream sets off: cost of its usage, and a scan of the whole output that
    warns but changes nothing that was sent (R5, R7). `streams` has text and model, and in_tok and
    out_tok, which count 0 where a stream gave no usage. Adds cost, decision and violations; works
    on tables and on streams of reassembled texts alike."""
    used = [F.coalesce(c, F.lit(0)) if c in streams.columns else F.lit(0) for c in ("in_tok", "out_tok")]
    scanned = scan(streams, "text", config).drop("safe", "sanitized", "scanners_run")
    return scanned.withColumn("cost", cost(F.col("model"), *used))


def text_events(events: DataFrame) -> DataFrame:
    """Text deltas of typed events; input usage from the start, output usage from the last delta."""
    delta = (F.col("type") == "content_block_delta") & (F.col("delta_type") == "text_delta")
    return events.withColumns(
        {
            "text": F.when(delta, F.col("text")),
            "in_tok": F.when(F.col("type") == "message_start", F.col("in_tok")),
            "out_tok": F.when(F.col("type") == "message_delta", F.col("out_tok")),
        }
    )


def spend_stream(records: DataFrame, period: str, lateness: str) -> DataFrame:
    """Running (entity_id, bucket, spend) of a stream of costs by event time; state of a bucket goes
    when the watermark has passed it (C7, C12)."""
    timed = records.withWatermark("ts", lateness)
    if period == "monthly":
        return timed.groupBy("entity_id", bucket(F.col("ts"), period).alias("bucket")).agg(F.sum("cost").alias("spend"))
    width = {"hourly": "1 hour", "daily": "1 day"}[period]
    return timed.groupBy("entity_id", F.window("ts", width)).agg(F.sum("cost").alias("spend")).select("entity_id", F.col("window.start").alias("bucket"), "spend")


def screen_stream(texts: DataFrame, config: ScanConfig, passed: Callable[[DataFrame], None], blocked: Callable[[DataFrame], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Scans a stream of texts and hands rows that pass, and rows that are blocked, to two writers
    in every micro-batch (R5, R6, X14)."""
    scanned = scan(texts, config=config)

    def write(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        passed(held.where("decision <> 'block'"))
        blocked(held.where("decision = 'block'"))
        held.unpersist()

    writer = scanned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
