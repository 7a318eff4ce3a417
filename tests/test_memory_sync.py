"""Incremental memories: which sessions are derived again, and that nothing else is."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import memory_sync

EVENTS = "session_id string, event_id long, text string"


def marks(spark, rows):
    return memory_sync.session_marks(spark.createDataFrame(rows, EVENTS), ["event_id", "text"])


def touched(spark, before, after):
    return {r["session_id"]: r["change"] for r in memory_sync.touched(marks(spark, before), marks(spark, after)).collect()}


def test_touched_sessions(spark):
    before = [("same", 1, "a"), ("same", 2, "b"), ("more", 1, "a"), ("other", 1, "a"), ("gone", 1, "a"), ("null", 1, None), ("twice", 1, "a"), (None, 1, "a")]
    after = [("same", 2, "b"), ("same", 1, "a"), ("more", 1, "a"), ("more", 2, "b"), ("other", 1, "b"), ("fresh", 1, "a"), ("null", None, None), ("twice", 1, "a"), ("twice", 1, "a"), (None, 2, "b")]
    assert touched(spark, before, after) == {"more": "changed", "other": "changed", "gone": "gone", "fresh": "new", "null": "changed", "twice": "changed"}
    assert touched(spark, before, before) == touched(spark, [], []) == {}


def derive(events):
    return events.select(
        F.concat_ws("/", "session_id", F.col("event_id").cast("string")).alias("memory_id"), "session_id", F.col("text").alias("body"),
        F.when(F.col("event_id") == 9, "extra").otherwise("v").alias("extractor_version"), F.lit("t2").alias("derived_at"), F.lit("t2").alias("updated_at"),
    )


def test_second_run(spark):
    first = [("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("b", 9, "z"), ("c", 1, "x")]
    second = [("a", 1, "x"), ("b", 1, "w"), ("b", 3, "y"), ("c", 1, "x")]
    known = derive(spark.createDataFrame(first, EVENTS)).withColumns({"derived_at": F.lit("t1"), "updated_at": F.lit("t1")})
    sessions = memory_sync.touched(marks(spark, first), marks(spark, second))
    found = memory_sync.changes(spark.createDataFrame(second, EVENTS), sessions, known, derive, "now", ["v"])
    assert {r["memory_id"]: r["change"] for r in found.collect()} == {"b/1": "update", "b/2": "delete", "b/3": "insert"}
    left = {r["memory_id"]: (r["body"], r["derived_at"], r["updated_at"]) for r in memory_sync.apply(known, found).collect()}
    assert left == {"a/1": ("x", "t1", "t1"), "b/1": ("w", "t1", "now"), "b/3": ("y", "t2", "t2"), "b/9": ("z", "t1", "t1"), "c/1": ("x", "t1", "t1")}
    unchanged = memory_sync.touched(marks(spark, second), marks(spark, second))
    assert memory_sync.changes(spark.createDataFrame(second, EVENTS), unchanged, known, derive, "now", ["v"]).count() == 0
