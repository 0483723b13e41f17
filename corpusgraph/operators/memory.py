"""Episodic memory: append-only facts, pins, recall and durable query handles."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.drift import last_per_key
from corpusgraph.schema import MEMORY

MEMORY_SCHEMA = "id string, kind string, name string, content string, origin string, path string, symbol string, span_hash string, state string, moved_from string, pinned boolean, created_at double, updated_at double, seq long"
AGENT_KINDS = ("decision", "failure", "task")
MOST_BYTES, MOST_PINS, MOST_QUERY = 16_000, 32, 2000


def new_id(prefix: str) -> str:
    """Time-ordered and unique: eleven hex digits of milliseconds and eight random ones."""
    return f"{prefix}_{int(time.time() * 1000):011x}{secrets.token_hex(4)}"


def memory_row(kind: str, content: str, *, origin: str = "user", anchor: dict | None = None, secret: bool = False, now: float | None = None) -> tuple:
    """A validated row of the memory table."""
    if kind not in MEMORY:
        raise ValueError(f"kind must be one of {', '.join(MEMORY)}")
    if origin == "agent" and kind not in AGENT_KINDS:
        raise PermissionError("agents may record decisions, failures and tasks only")
    if not 1 <= len(content.encode("utf-8")) <= MOST_BYTES or not content.strip():
        raise ValueError(f"content must have 1 to {MOST_BYTES} bytes")
    if secret:
        raise PermissionError("content looks like a credential")
    at, a = time.time() if now is None else now, anchor or {}
    name = content.strip().split("\n", 1)[0][:120]
    return (new_id(kind[:4]), kind, name, content, origin, a.get("path"), a.get("symbol"), a.get("span_hash"), "fresh", None, False, at, at, 0)


def rows(spark: SparkSession, items: list[tuple]) -> DataFrame:
    return spark.createDataFrame(items, MEMORY_SCHEMA)


def current(log: DataFrame) -> DataFrame:
    """The latest version of each memory in the append-only log."""
    return last_per_key(log, ["id"], "seq")


def pin_row(log: DataFrame, memory_id: str, value: bool, now: float | None = None) -> DataFrame:
    """A new log row that sets the pin and the time of change."""
    row = current(log).filter(F.col("id") == memory_id)
    return row.withColumns({"pinned": F.lit(value), "updated_at": F.lit(time.time() if now is None else now), "seq": F.col("seq") + 1}).select(*log.columns)


def set_state(log: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    return log.join(ids.withColumn("hit", F.lit(True)), "id", "left").withColumn("state", F.when(F.col("hit"), state).otherwise(F.col("state"))).drop("hit")


def pinned_first(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """(id, tier, rank): pinned rows in their order, then found rows that aren't pinned."""
    rest = found.join(pinned.select("id"), "id", "left_anti")
    return pinned.select("id", F.lit(0).alias("tier"), "rank").unionByName(rest.select("id", F.lit(1).alias("tier"), "rank"))


def labels_of(subject_labels) -> F.Column:
    return F.array_sort(F.array_union(F.array(F.lit("derived"), F.lit("repo:private")), subject_labels))
