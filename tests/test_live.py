"""Streams that keep state: admission, reassembly, buffers."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textweir.operators import cost
from textweir.streaming import chunks, live

CALLS = "event_id long, entity_id string, ts timestamp, estimate double, cost double, spend string"
BUDGETS = {"a": cost.Budget(1.0, 3.0, "hourly"), "b": cost.Budget(2.0, 5.0, "daily")}


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        out.writelines(json.dumps(r, default=str) + "\n" for r in rows)
    time.sleep(0.02)  # files are read in order of their times


def ran(df, name, path, **trigger):
    query = df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    assert query.awaitTermination(240)
    return query


def call_rows(n, seed):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, 7]))
        rows.append({"event_id": i, "entity_id": rng.choice(["a", "b", "free", None]), "ts": at.isoformat(), "estimate": rng.randint(1, 8) / 8, "cost": rng.randint(0, 8) / 8, "spend": "clash"})
    return rows


def test_live_admission_equals_the_gate_also_after_a_restart(spark, tmp_path):
    rows, source = call_rows(300, 1), f"{tmp_path}/in"
    budgets = cost.budgets_table(spark, BUDGETS)
    stream = lambda: live.admit_stream(spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(source), budgets, "event_id")
    put(source, "0", rows[:90])
    put(source, "1", rows[90:170])
    ran(stream(), "out", tmp_path)
    put(source, "2", rows[170:])
    ran(stream(), "out", tmp_path)
    got = {r.event_id: (r.spend, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = spark.read.schema(CALLS).json(source).drop("spend").join(budgets, "entity_id").withColumn("bucket", cost.bucket(F.col("ts"), F.col("period")))
    gated = cost.gated(table, ["entity_id", "bucket"], "ts", "event_id", "estimate", "cost", "hard_limit")
    want = {r.event_id: (r.spend, r.allowed) for r in gated.collect()}
    assert any(not ok for _, ok in want.values()) and len(got) == len(rows)
    assert {i: got[i] for i in want} == want
    assert all(got[r["event_id"]] == (0.0, True) for r in rows if r["entity_id"] not in BUDGETS)


def test_counters_expire(spark, tmp_path):
    source = f"{tmp_path}/in"
    call = lambda i, at, entity="a": {"event_id": i, "entity_id": entity, "ts": at, "estimate": 1.0, "cost": 1.0}
    put(source, "0", [call(0, "2024-01-01T00:10:00"), call(1, "2024-01-01T00:20:00")])
    put(source, "1", [call(2, "2024-01-01T02:30:00", "free")])  # the watermark passes two periods
    put(source, "2", [call(3, "2024-01-01T02:40:00", "free")])
    put(source, "3", [call(4, "2024-01-01T00:30:00")])  # a counter that has gone starts again
    events = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(source)
    budgets = cost.budgets_table(spark, BUDGETS)
    query = ran(live.admit_stream(events, budgets, "event_id", lateness="0 seconds"), "out", tmp_path)
    assert query.recentProgress[-1]["stateOperators"][0]["customMetrics"] is not None
    got = {r.event_id: r.spend for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {i: got[i] for i in (0, 1, 2, 3)} == {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0}
    assert 4 not in got  # later than the lateness that was asked for
    whole = ran(live.admit_stream(events, budgets, "event_id"), "all", tmp_path)
    assert whole.exception() is None
    assert {r.event_id: r.spend for r in spark.read.parquet(f"{tmp_path}/all").collect()}[4] == 2.0


EVENTS = "stream_id string, seq long, payload string, ts timestamp, model string"
FORMS = {
    "delta": [
        {"choices": [{"delta": {"content": "Hel"}}]},
        {"choices": [{"delta": {"content": "lo, write to jane.doe@example.org"}}]},
        {"choices": [{"delta": {}, "finish_reason": "stop"}]},
        {"choices": [], "usage": {"prompt_tokens": 1000, "completion_tokens": 500}},
    ],
    "typed": [
        {"type": "message_start", "message": {"usage": {"input_tokens": 1000, "output_tokens": 1}}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "Hello, write to "}},
        {"type": "content_block_delta", "delta": {"type": "input_json_delta", "text": "no"}},
        {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "jane.doe@example.org"}},
        {"type": "message_delta", "usage": {"output_tokens": 500}},
        {"type": "message_stop"},
    ],
    "candidates": [
        {"candidates": [{"content": {"parts": [{"text": "Hello, "}, {"text": "write "}]}}]},
        "{broken",
        {"candidates": [{"content": {"parts": [{"text": "to jane.doe@example.org"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 1000, "candidatesTokenCount": 500}},
    ],
}


@pytest.mark.parametrize("form", FORMS)
def test_live_responses(spark, tmp_path, form):
    said = [e if isinstance(e, str) else json.dumps(e) for e in FORMS[form]]
    rows = [{"stream_id": "s", "seq": i, "payload": e, "ts": f"2024-01-01T00:00:0{i}", "model": "gpt-4o-mini"} for i, e in enumerate(said)]
    if form == "delta":  # usage comes after the end was told, so here the last event ends the stream
        rows[2]["payload"] = json.dumps({"choices": [{"delta": {}}]})
        rows[3]["payload"] = json.dumps({"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1000, "completion_tokens": 500}})
    source = f"{tmp_path}/in"
    put(source, "0", [rows[-1], rows[1]])  # out of order, over batches, one of them twice
    put(source, "1", [rows[1], {**rows[0], "stream_id": "open"}])
    put(source, "2", [r for i, r in enumerate(rows) if i not in (1, len(rows) - 1)])
    put(source, "3", [{**rows[0], "stream_id": "other", "ts": "2024-01-01T09:00:00"}])
    put(source, "4", [{**rows[0], "stream_id": "other", "seq": 1, "ts": "2024-01-01T09:00:01"}])
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(source).withWatermark("ts", "1 minute")
    ended = chunks.finish(chunks.reassemble_stream(live.response_chunks(events, form), keep=["model"]))
    ran(ended, "out", tmp_path)
    got = {r.stream_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    done = got["s"]
    assert (done.text, done.complete, done.n_chunks, done.in_tok, done.out_tok) == ("Hello, write to jane.doe@example.org", True, len(rows), 1000, 500)
    assert done.decision == "warn" and done.cost == pytest.approx(1000 / 1e6 * 0.15 + 500 / 1e6 * 0.6)
    assert not got["open"].complete and got["open"].n_chunks == 1 and "other" not in got
    table = chunks.finish(chunks.reassemble(live.response_chunks(spark.createDataFrame([(r["stream_id"], r["seq"], r["payload"], None, r["model"]) for r in rows], EVENTS), form), keep=["model"])).head()
    assert (table.text, table.in_tok, table.out_tok, table.cost, table.decision) == (done.text, 1000, 500, done.cost, "warn")


def test_buffer_flushes_by_count_and_age(spark, tmp_path):
    source, at = f"{tmp_path}/in", "2024-01-01T00:00:00"
    put(source, "0", [{"id": i, "at": at, "tags": ["x"]} for i in range(3)])
    stream = spark.readStream.schema("id long, at timestamp, tags array<string>, note string").option("maxFilesPerTrigger", 1).json(source)
    held = live.buffered(stream, rows=5, seconds=3600, by=F.lit(1))  # timers by the clock never end by themselves, so one batch each
    seen = lambda: sorted(r.id for r in spark.read.schema("id long").parquet(f"{tmp_path}/out").collect())
    ran(held, "out", tmp_path, once=True)
    assert seen() == []
    put(source, "1", [{"id": i, "at": at, "tags": None} for i in range(3, 6)])
    ran(held, "out", tmp_path, once=True)
    assert seen() == list(range(6))
    put(source, "2", [{"id": 6, "at": at}])
    aged = live.buffered(stream, rows=5, seconds=0.2, by=F.lit(1))
    query = aged.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/out-checkpoint").trigger(processingTime="100 milliseconds").start()
    until = time.time() + 120
    while time.time() < until and len(seen()) < 7:
        time.sleep(0.3)
    query.stop()
    assert seen() == list(range(7))
