"""A stream of growing files: bounded batches, state over batch edges, faults, and one result however it is cut."""

from __future__ import annotations

import json

import pytest

from tidemark.sources import rollouts
from tidemark.streaming import ingest
from tidemark.streaming.ingest import FileState


def item(said, n, second=1):
    return {"timestamp": f"2024-01-01T00:00:0{second}Z", "type": "response_item", "payload": {"type": "message", "role": "user", "id": f"m{n}", "content": said}}


def mirror(said, second=1):
    return {"timestamp": f"2024-01-01T00:00:0{second}Z", "type": "event_msg", "payload": {"type": "user_message", "message": said}}


def meta(session):
    return {"type": "session_meta", "payload": {"id": session}}


#: Where a bar stands the first batch ends: a mirror, and a session's later lines, lie beyond it.
LINES = [meta("s1"), item("one", 1), mirror("one"), item("two", 2), None, mirror("two"), item("three", 3), meta("s2"), item("four", 4), mirror("one", 1), mirror("five", 5), mirror("five", 5)]


def written(path, records):
    with open(path, "a") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


def events_of(spark, table):
    schema = ingest.canonical_events(spark.createDataFrame([], rollouts.LINE_SCHEMA)).schema
    return sorted((r.session_key, r.ordinal, r.kind, r.text, r.event_id, r.content_hash) for r in table.read(schema).collect())


@pytest.mark.parametrize("most_bytes", [200, 1 << 20])
def test_cut_anywhere_it_is_one_result(spark, tmp_path, most_bytes):
    logs = tmp_path / "logs"
    logs.mkdir()
    bar = LINES.index(None)
    whole = [r for r in LINES if r is not None]
    written(logs / "a.jsonl", LINES[:bar])
    home = (str(tmp_path / "events"), str(tmp_path / "checkpoint"))
    ingest.ingest(spark, str(logs / "*.jsonl"), *home, most_bytes=most_bytes)
    written(logs / "a.jsonl", [*LINES[bar + 1 :], "{broken", json.dumps({"payload": 1})])
    table = ingest.ingest(spark, str(logs / "*.jsonl"), *home, most_bytes=most_bytes)
    found = events_of(spark, table)
    assert sorted((s, t) for s, _, _, t, *_ in found) == [("s1", "one"), ("s1", "three"), ("s1", "two"), ("s2", "five"), ("s2", "five"), ("s2", "four"), ("s2", "one")]
    lines = spark.read.format("jsonl_log").option("path", str(logs / "*.jsonl")).option("split_bytes", 150).load()
    assert lines.rdd.getNumPartitions() > 5  # tasks read ranges of the file, and no line passes the driver
    at_once = sorted((r.session_key, r.ordinal, r.kind, r.text, r.event_id, r.content_hash) for r in ingest.canonical_events(lines).collect())
    assert found == at_once and len(whole) == 11
    faults = ingest.EventTable(spark, f"{home[0]}/faults").read("path string, byte_start long, byte_end long, fault string").collect()
    assert sorted(r.fault for r in faults) == ["MALFORMED_JSON", "MISSING_TYPE"]


def test_a_rotated_file_begins_anew(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    home = (str(tmp_path / "events"), str(tmp_path / "checkpoint"))
    written(logs / "a.jsonl", [meta("s1"), item("one", 1)])
    ingest.ingest(spark, str(logs / "*.jsonl"), *home)
    written(logs / "b.tmp", [item("other", 7)])
    (logs / "b.tmp").rename(logs / "a.jsonl")
    table = ingest.ingest(spark, str(logs / "*.jsonl"), *home)
    assert {t: s == "s1" for s, _, _, t, *_ in events_of(spark, table)} == {"one": True, "other": False}
    faults = ingest.EventTable(spark, f"{home[0]}/faults").read("path string, byte_start long, byte_end long, fault string").collect()
    assert [r.fault for r in faults] == ["ROTATED"]


def test_mirrors_by_plain_rules():
    state = FileState()
    assert [state.mirrored(*m) for m in (("k", 1, "item"), ("k", 2, "mirror"), ("k", 3, "mirror"), ("k", 4, "item"), ("k", 13, "mirror"), ("k", 14, "item"), ("j", 15, "item"))] == [False, True, True, False, False, True, False]
    assert FileState.of(state.stored()) == state and len(state.recent) == 2
