"""Audit records that hold hashes only (A1-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .injection import utf16_length


def user_hash(user: Column) -> Column:
    """The first 16 digits of a user's SHA-256; none for no user or an empty one."""
    return F.when(F.length(user) > 0, F.substring(F.sha2(user, 256), 1, 16))


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4)


def reason(violations: Column) -> Column:
    return F.when(F.size(violations) > 0, F.array_join(F.transform(violations, lambda v: v["message"]), "; "))


def records(scanned: DataFrame, text: str, at: str, user: str | None = None, session: str | None = None, agent: str | None = None, tools: str | None = None, model: Column | None = None) -> DataFrame:
    """One record for each scanned row; rows that a cache answered (cached = true) give none."""
    if "cached" in scanned.columns:
        scanned = scanned.where(~F.coalesce(F.col("cached"), F.lit(False)))
    given = lambda c: F.col(c) if c else F.lit(None).cast("string")
    called = F.size(F.coalesce(F.col(tools), F.array().cast("array<struct<name:string,server_id:string>>"))) > 0 if tools else F.lit(False)
    return scanned.select(
        F.uuid().alias("id"),
        F.col(at).alias("timestamp"),
        given(session).alias("session_id"),
        given(agent).alias("agent_id"),
        user_hash(given(user)).alias("user_id_hash"),
        F.when(called, "tool_call").otherwise("chat").alias("request_type"),
        F.sha2(F.col(text), 256).alias("input_hash"),
        token_estimate(F.col(text)).alias("input_token_count"),
        (F.lit(None).cast("string") if model is None else model).alias("model"),
        F.col("decision").alias("security_decision"),
        reason(F.col("violations")).alias("security_reason"),
        F.to_json("violations").alias("violations"),
        F.to_date(F.date_trunc("month", F.col(at))).alias("created_month"),
    )
