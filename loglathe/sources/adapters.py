"""The logical tables of the session model, from the tables that are provided.

All are lazy and touch only the columns that they need.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def octets(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with session, ordinal (dense from 1 in time), wall_ms and k, the number in props."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("session"),
        F.row_number().over(order).cast("bigint").alias("ordinal"),
        "event_id",
        F.col("event_type").alias("kind"),
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        millis(F.col("ts")).alias("wall_ms"),
    )


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider ledger: one response for each event, with its usage."""
    e = log(spark, sf_dir)
    return e.select(
        "session", "ordinal", "event_id", "kind", "props", "k", "wall_ms",
        (F.col("event_id") % 997 + 1).alias("input"),
        (F.col("event_id") * 37 % 4001).alias("cache_read"),
        (F.col("event_id") % 13).alias("cache_write"),
        F.round("value").cast("bigint").alias("output"),
        F.when(F.col("kind") == "error", "error").otherwise("stop").alias("stop_reason"),
    ).withColumn("prompt", F.col("input") + F.col("cache_read") + F.col("cache_write"))


def tool_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool result for each event: name, digest, bytes and tokens of its payload."""
    e = log(spark, sf_dir)
    size = octets(F.col("props"))
    return e.select("session", "ordinal", F.col("kind").alias("tool"), F.sha2("props", 256).alias("sha"), size.alias("nbytes"), F.ceil(size / 4).cast("bigint").alias("tokens"))


def pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases, and the requests that were due some milliseconds later."""
    e = log(spark, sf_dir)
    return e.select("session", "ordinal", F.col("wall_ms").alias("released"), (F.col("wall_ms") + F.round("value").cast("bigint")).alias("requested"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each conversation: session, idx, role, text, nbytes, terminal."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "system", "custom").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), role.alias("role"), "text", octets(F.col("text")).alias("nbytes"), (F.col("role") == "assistant").alias("terminal"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session tree: entries with parents; in conversations of odd number, turns from the third on leave the trunk at turn 1."""
    c = table(spark, sf_dir, "conversations")
    entry = F.col("conv_id") * 100 + F.col("turn")
    forked = (F.col("conv_id") % 2 == 1) & (F.col("turn") == 3)
    parent = F.when(F.col("turn") == 0, None).when(forked, F.col("conv_id") * 100 + 1).otherwise(entry - 1)
    return c.select(F.col("conv_id").alias("session"), entry.alias("entry"), parent.alias("parent"), F.col("turn").alias("idx"), "role", "text")


#: The same tables for the oracle, as common table expressions.
ORACLE = {
    "log": """log AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, event_id, event_type AS kind,
        value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS wall_ms FROM events)""",
    "provider": """provider AS (SELECT *, input + cache_read + cache_write AS prompt FROM (SELECT session, ordinal, event_id, kind, props, k, wall_ms, event_id % 997 + 1 AS input,
        event_id * 37 % 4001 AS cache_read, event_id % 13 AS cache_write, CAST(round(value) AS BIGINT) AS output,
        CASE WHEN kind = 'error' THEN 'error' ELSE 'stop' END AS stop_reason FROM log))""",
    "tools": """tools AS (SELECT session, ordinal, kind AS tool, sha256(props) AS sha, octet_length(encode(props)) AS nbytes,
        CAST(ceil(octet_length(encode(props)) / 4.0) AS BIGINT) AS tokens FROM log)""",
    "pace": """pace AS (SELECT session, ordinal, wall_ms AS released, wall_ms + CAST(round(value) AS BIGINT) AS requested FROM log)""",
    "messages": """messages AS (SELECT conv_id AS session, turn AS idx, CASE WHEN role = 'system' THEN 'custom' ELSE role END AS role, text,
        octet_length(encode(text)) AS nbytes, role = 'assistant' AS terminal FROM conversations)""",
    "entries": """entries AS (SELECT conv_id AS session, conv_id * 100 + turn AS entry, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 2 = 1 AND turn = 3 THEN conv_id * 100 + 1
        ELSE conv_id * 100 + turn - 1 END AS parent, turn AS idx, role, text FROM conversations)""",
}


def with_tables(*names: str) -> str:
    """The head of an oracle query over these logical tables."""
    if "provider" in names or "tools" in names or "pace" in names:
        names = ("log", *(n for n in names if n != "log"))
    return "WITH " + ",\n".join(ORACLE[n] for n in names)
