from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.sources import objects, policy, rollouts


def test_discovery_and_policy(spark, tmp_path):
    home = tmp_path / "home"
    (home / "sessions" / "2024").mkdir(parents=True)
    for name in ("history.jsonl", "sessions/2024/rollout-1.jsonl", "sessions/notes.txt", "auth.json"):
        (home / name).write_text("{}\n")
    os.symlink(home / "history.jsonl", home / "sessions" / "rollout-link.jsonl")
    found = policy.discover([str(home), str(tmp_path / "none")])
    assert [(os.path.relpath(r.path, home), r.kind) for r in found] == [("history.jsonl", "history"), ("sessions/2024/rollout-1.jsonl", "rollout")]
    paths = spark.createDataFrame([(str(home / p),) for p in ("history.jsonl", "auth.json", "x.jsonl")] + [("/elsewhere/history.jsonl",)], "p string")
    reasons = [r.x for r in paths.select(policy.refusal(F.lit(str(home)), F.col("p")).alias("x")).collect()]
    assert reasons == [None, "forbidden_name", "unknown_shape", "outside_home"]


def test_object_store(tmp_path):
    store = objects.ObjectStore(str(tmp_path))
    address = store.put(b"data")
    assert store.put(b"data") == address and store.get(address) == b"data" and store.has(address)
    assert store.collect_orphans(set()) == []  # too young
    assert store.collect_orphans(set(), least_age=0, dry_run=True) == [address] and store.has(address)
    assert store.collect_orphans({address}, least_age=0) == []
    assert store.collect_orphans(set(), least_age=0) == [address] and not store.has(address)
    with pytest.raises(ValueError):
        store.get("../x")


def test_history_and_titles(spark):
    lines = [("h", 0, '{"session_id":"s","ts":1700000000,"text":"hi"}'), ("h", 9, '{"id":"t","title":"x"}'), ("h", 20, "{broken"), ("h", 30, "{}")]
    df = spark.createDataFrame(lines, "path string, byte_start long, line string")
    assert [(r.session_key, r.result) for r in rollouts.parse_history(df).orderBy("byte_start").collect()] == [("s", "evidence"), ("t", "metadata"), (None, "MALFORMED_JSON"), (None, "MISSING_SESSION")]
    index = [("i", 0, '{"id":"s","thread_name":"old","updated_at":"1"}'), ("i", 5, '{"id":"s","thread_name":"new","updated_at":"2"}')]
    titles = rollouts.parse_session_index(spark.createDataFrame(index, "path string, byte_start long, line string")).collect()
    assert [(t.session_key, t.title) for t in titles] == [("s", "new")]


def test_evidence_union_keeps_first_places(spark):
    row = spark.range(1).select(evidence.union_ids(F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("c"))).alias("x"))
    assert row.collect()[0].x == ["b", "a", "c"]
