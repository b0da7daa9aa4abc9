"""State that lives between batches: budgets, unfinished responses, records to flush (C9, C12, C16,
R1-R5, A6). All of it is kept by key in the RocksDB store, which timers need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textweir.functions.names import fresh
from textweir.operators.cost import PERIOD_SECONDS, bucket

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys over which calls without a budget, and records to flush, are dealt.
SPREAD = 64
#: Key of calls that no budget counts; never the start of an hour.
NO_BUCKET = -1


def keep_state(spark: SparkSession) -> None:
    """Streams that a session starts from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def milliseconds(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


@lru_cache(1)
def local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="textweir-")


def finished(stream: DataFrame) -> DataFrame:
    """Runs a stream over what its sources hold now and gives its result as a table, in the folder of
    spark.checkpoint.dir. Only a local master may do without that setting."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = local_folder()
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


class Admission(StatefulProcessor):
    """The sum that an entity has spent in a bucket, and a timer two periods after its start."""

    def __init__(self, at: str, tie: str, estimate: str, actual: str, limit: str, period: str) -> None:
        self.names = at, tie, estimate, actual, limit
        self.period = period

    def init(self, handle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "spent double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, tie, estimate, actual, limit = self.names
        calls = pd.concat(list(rows)).sort_values([at, tie], kind="stable").assign(entity_id=key[0])
        if key[1] == NO_BUCKET:
            yield calls.assign(spend=0.0, allowed=True)
            return
        known = self.spent.exists()
        total = self.spent.get()[0] if known else 0.0
        spends, oks = [], []
        for wanted, real, most in zip(calls[estimate], calls[actual], calls[limit]):
            ok = total + wanted <= most
            spends.append(total)
            oks.append(ok)
            total += real if ok else 0.0
        self.spent.update((total,))
        if not known:
            self.handle.registerTimer(int(key[1]) + 2000 * PERIOD_SECONDS[calls[self.period].iloc[0]])
        yield calls.assign(spend=spends, allowed=oks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        yield from ()

    def close(self) -> None:
        pass


def admit_stream(calls: DataFrame, budgets: DataFrame, tie: str, estimate: str = "estimate", actual: str = "cost", lateness: str | None = None) -> DataFrame:
    """Adds period, soft_limit, hard_limit, bucket, spend and allowed to a stream of calls
    (entity_id, ts, estimate and actual cost): a call is allowed while what its entity spent in the
    bucket and the estimate stay within the hard limit, and only allowed calls count (C9, C16).

    Decisions are made as calls come: within a batch by time and `tie`, as gated() makes them, and a
    late call after those that were decided. A bucket's counter goes when the watermark is two
    periods past its start (C12). The watermark follows `lateness`, by default two of the longest
    periods, so Spark leaves out only calls whose counter is gone; a shorter one leaves out those
    that are later than it. Entities without a budget are allowed and keep no sum; their calls, and
    calls without a time, are dealt over keys. A restart goes on from the checkpoint.
    """
    keep_state(calls.sparkSession)
    longest = budgets.agg(F.max(F.element_at(F.create_map(*[x for p, n in PERIOD_SECONDS.items() for x in (F.lit(p), F.lit(n))]), F.col("period")))).head()[0]
    made = ["period", "soft_limit", "hard_limit", "bucket", "spend", "allowed"]
    kept = [c for c in calls.columns if c not in made]
    timed = calls.select(kept).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness or f"{2 * (longest or 0)} seconds")
    limits = timed.join(budgets.select("entity_id", "period", "soft_limit", "hard_limit"), "entity_id", "left").withColumn("bucket", bucket(F.col("ts"), F.col("period")))
    start, dealt = fresh(limits, "_start", "_dealt")
    spread = F.when(F.col("bucket").isNull(), F.pmod(F.xxhash64(tie), F.lit(SPREAD)).cast("int")).otherwise(0)
    keyed = limits.withColumns({start: F.coalesce(F.unix_millis("bucket"), F.lit(NO_BUCKET)), dealt: spread})
    schema = f"{limits.schema.simpleString()[7:-1]}, spend double, allowed boolean"
    processor = Admission("ts", tie, estimate, actual, "hard_limit", "period")
    done = keyed.groupBy("entity_id", start, dealt).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return done.select(*kept, *made)


def response_chunks(events: DataFrame, form: str, payload: str = "payload") -> DataFrame:
    """Adds text, in_tok, out_tok and last to JSON events of a stream of a response.

    `form` says where they are: "delta" has choices with deltas and usage in some chunk; "typed"
    has events by type, input usage in the first and output usage in the last; "candidates" has
    parts and usage in each. Events that cannot be read add nothing.
    """
    parsed = F.try_parse_json(payload)
    at = lambda path, kind: F.try_variant_get(parsed, path, kind)
    if form == "delta":
        out = at("$.choices[0].delta.content", "string"), at("$.usage.prompt_tokens", "long"), at("$.usage.completion_tokens", "long"), at("$.choices[0].finish_reason", "string").isNotNull()
    elif form == "typed":
        kind = F.coalesce(at("$.type", "string"), F.lit(""))
        said = F.when((kind == "content_block_delta") & (at("$.delta.type", "string") == "text_delta"), at("$.delta.text", "string"))
        out = said, F.when(kind == "message_start", at("$.message.usage.input_tokens", "long")), F.when(kind == "message_delta", at("$.usage.output_tokens", "long")), kind == "message_stop"
    elif form == "candidates":
        parts = F.transform(at("$.candidates[0].content.parts", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        out = F.array_join(parts, ""), at("$.usageMetadata.promptTokenCount", "long"), at("$.usageMetadata.candidatesTokenCount", "long"), at("$.candidates[0].finishReason", "string").isNotNull()
    else:
        raise ValueError(f"no form of events is called {form!r}")
    return events.withColumns(dict(zip(("text", "in_tok", "out_tok", "last"), out)))


class Reassembly(StatefulProcessor):
    """Chunks of a response in a list that only grows, and beside it how many there are, where the
    end is, and the latest of each value to keep with its place."""

    def __init__(self, keep: Sequence[str], kinds: dict[str, str], wait: int) -> None:
        self.keep, self.kinds, self.wait = list(keep), kinds, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, text string")
        values = "".join(f", seq_{i} long, value_{i} {self.kinds[c]}" for i, c in enumerate(self.keep))
        self.known = handle.getValueState("known", f"n long, end long, due long{values}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, end, due, *values = self.known.get() if self.known.exists() else (0, -1, 0, *[None] * (2 * len(self.keep)))
        parts, latest = [], due - self.wait
        for batch in rows:
            parts += [(int(s), t if isinstance(t, str) else "") for s, t in zip(batch["seq"], batch["text"])]
            latest = max([latest, *map(milliseconds, batch["ts"].dropna())])
            end = max([end, *(int(s) for s, last in zip(batch["seq"], batch["last"]) if last is True or last == 1)])
            for i, c in enumerate(self.keep):
                for seq, value in zip(batch["seq"], batch[c]):
                    if not pd.isna(value) and (values[2 * i] is None or seq >= values[2 * i]):
                        values[2 * i : 2 * i + 2] = [int(seq), value if isinstance(value, str) else int(value)]
        n += len(parts)
        self.parts.appendList(parts)
        if end >= 0 and n > end:
            held = self.held()  # repeated chunks count too, so the list decides
            if sum(s <= end for s in held) == end + 1:
                if due:
                    self.handle.deleteTimer(due)
                yield self.whole(key, held, True, values)
                return
        if latest + self.wait > due:
            if due:
                self.handle.deleteTimer(due)
            due = max(latest, timerValues.getCurrentWatermarkInMs() + 1) + self.wait
            self.handle.registerTimer(due)
        self.known.update((n, end, due, *values))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            _, end, _, *values = self.known.get()
            yield self.whole(key, self.held(), False, values)

    def held(self) -> dict[int, str]:
        return {row[0]: row[1] for row in self.parts.get()}

    def whole(self, key, held: dict[int, str], complete: bool, values: list) -> pd.DataFrame:
        self.parts.clear()
        self.known.clear()
        row = {"stream_id": key[0], "text": "".join(held[i] for i in sorted(held)), "n_chunks": len(held), "complete": complete}
        frame = pd.DataFrame([row])
        for i, c in enumerate(self.keep):
            frame[c] = pd.Series([values[2 * i + 1]], dtype="object" if self.kinds[c] == "string" else "Int64")
        return frame

    def close(self) -> None:
        pass


def reassemble_stream(chunks: DataFrame, timeout: str = "10 minutes", keep: Sequence[str] = ()) -> DataFrame:
    """(stream_id, text, n_chunks, complete, and in_tok, out_tok and `keep` where chunks have them)
    from a stream of (stream_id, seq, text, last, ts), ts watermarked by the caller (R1-R5).

    Chunks are kept until all up to the last one have come, in whatever order; new ones are
    appended to what is kept, nothing is written again. Null texts add nothing, a repeated chunk
    counts once, and the latest non-null usage (by seq) wins. A stream without an end comes as far
    as it got, complete false, when the watermark passes `timeout` after its latest chunk. finish()
    takes the result.
    """
    keep_state(chunks.sparkSession)
    kinds = {c: "string" if kind == "string" else "long" for c, kind in chunks.dtypes}
    kept = [c for c in ("in_tok", "out_tok", *keep) if c in kinds]
    rows = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), "text", "last", "ts", *[F.col(c).cast(kinds[c]).alias(c) for c in kept])
    schema = f"stream_id {dict(chunks.dtypes)['stream_id']}, text string, n_chunks long, complete boolean" + "".join(f", {c} {kinds[c]}" for c in kept)
    processor = Reassembly(kept, kinds, int(pd.Timedelta(timeout).total_seconds() * 1000))
    return rows.groupBy("stream_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


class Buffer(StatefulProcessor):
    """Records of a key, as Arrow batches, until there are `rows` of them or `wait` milliseconds
    have passed."""

    def __init__(self, rows: int, wait: int, columns: Sequence[str]) -> None:
        self.rows, self.wait, self.columns = rows, wait, list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "batch binary")
        self.known = handle.getValueState("known", "n long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, due = self.known.get() if self.known.exists() else (0, 0)
        for batch in rows:
            new = batch[self.columns]
            if n + len(new) < self.rows:
                self.records.appendValue((packed(new),))
                n += len(new)
                continue
            yield from self.flush(due)
            n, due = 0, 0
            yield new
        if n:
            if not due:
                due = timerValues.getCurrentProcessingTimeInMs() + self.wait
                self.handle.registerTimer(due)
            self.known.update((n, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.flush(0)

    def flush(self, due: int) -> Iterator[pd.DataFrame]:
        if due:
            self.handle.deleteTimer(due)
        held = [pa.ipc.open_stream(row[0]).read_pandas() for row in self.records.get()] if self.records.exists() else []
        self.records.clear()
        self.known.clear()
        yield from held

    def close(self) -> None:
        pass


def buffered(records: DataFrame, rows: int = 100, seconds: float = 1.0, by: Column | None = None) -> DataFrame:
    """A stream of records held back until `rows` of a key are there or its oldest one is `seconds`
    old, whichever comes first (A6). Records are dealt to SPREAD keys by their hash, or go by `by`;
    a key holds fewer than `rows`. Buffered records are in the checkpoint, so none is lost."""
    keep_state(records.sparkSession)
    (key,) = fresh(records, "_key")
    schema = records.schema.simpleString()[7:-1]
    processor = Buffer(rows, int(seconds * 1000), records.columns)
    hashed = F.pmod(F.xxhash64(*records.columns), F.lit(SPREAD)) if by is None else by
    return records.withColumn(key, hashed).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")
