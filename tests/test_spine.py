"""From JSON lines in two batches to events, chunks, memories, the index and a search."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.plans import engine
from tidemark.streaming import ingest

SESSIONS = ("aaaaaaaa-0000-0000-0000-000000000001", "aaaaaaaa-0000-0000-0000-000000000002")


def line(kind, **payload):
    return json.dumps({"timestamp": payload.pop("at", "2024-01-01T00:00:00Z"), "type": kind, "payload": payload}) + "\n"


def message(role, said, at, n):
    return line("response_item", type="message", role=role, content=said, id=f"m{n}", at=at)


FIRST = [
    line("session_meta", id=SESSIONS[0]),
    message("user", "Make the lantern in src/app/lantern.py brighter.", "2024-01-01T00:00:01Z", 1),
    message("assistant", "We decided to use the red cache because it is fast.", "2024-01-01T00:00:02Z", 2),
]
SECOND = [
    message("user", "TODO: need to check the lantern again.", "2024-01-02T00:00:01Z", 3),
    line("response_item", type="function_call", name="run", arguments="{}", call_id="c1", id="t1", at="2024-01-02T00:00:02Z"),
    line("response_item", type="function_call_output", output="TypeError: lantern is not a function", call_id="c1", id="t2", at="2024-01-02T00:00:03Z"),
    message("assistant", "We decided to use disk instead of the red cache.", "2024-01-02T00:00:04Z", 4),
]


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("spine")
    logs = home / "logs"
    logs.mkdir()
    (logs / "one.jsonl").write_text("".join(FIRST))
    (logs / "two.jsonl").write_text(line("session_meta", id=SESSIONS[1]) + message("user", "Where is the lantern?", "2024-01-03T00:00:01Z", 9))
    for more in ([], SECOND):
        with open(logs / "one.jsonl", "a") as f:
            f.writelines(more)
        table = ingest.ingest(spark, str(logs / "*.jsonl"), str(home / "events"), str(home / "checkpoint"))
    events = table.read(ingest.canonical_events(spark.createDataFrame([], "path string, byte_start long, byte_end long, line string, problem string")).schema)
    keys = {r.session_key: r.session_id for r in events.select("session_key", "session_id").distinct().collect()}
    scopes = spark.createDataFrame(
        [("project", "p", "Alpha", "p", None), *(("session", keys[s], s, "p", None) for s in SESSIONS)],
        "scope_kind string, scope_id string, name string, project_id string, workstream_id string",
    )
    gone = spark.createDataFrame([], "project_id string, workstream_id string, session_id string, reason string")
    aliases = spark.createDataFrame([], "scope_kind string, scope_id string, alias string")
    known = spark.createDataFrame([(keys[SESSIONS[0]], "main"), (keys[SESSIONS[1]], "side")], "session_id string, branch string")
    made = engine.Engine(spark, engine.Tables(events, scopes, gone, aliases, known))
    made.index()
    return made, keys


def test_both_batches_are_one_session_with_its_memories(ready):
    made, keys = ready
    rows = {r.session_id: r for r in made.t.chunks.collect()}
    one = rows[keys[SESSIONS[0]]]
    assert len(one.event_ids) == 6
    assert one.display_text.startswith("User:\nMake the lantern in src/app/lantern.py brighter.\n\nAssistant:\nWe decided")
    assert one.embedding_text.startswith("User: Make the lantern in src/app/lantern.py brighter.\n\nAssistant: We decided")
    told = {(r.type, r.session_id): r for r in made.overview({"project_id": "p"}).collect()}
    body = told["session_synopsis", keys[SESSIONS[0]]].body
    assert "Goal\nMake the lantern in" in body and "Current state\nWe decided to use" in body and "We decided to use disk" in body
    assert {r.status for r in made.t.memories.filter("type = 'decision'").collect()} <= {"candidate", "superseded"}


def test_searches_are_narrowed_and_checked(ready, spark):
    made, keys = ready
    first, second = (keys[s] for s in SESSIONS)
    project = {"project_id": "p"}
    found = made.search("lantern", project)
    assert {i["session"] for i in found.items} == {first, second} and found.extra["intent"] == "general"
    assert {i["type"] for i in made.search("lantern", project, types=["open_item"]).items} == {"open_item"}
    assert {i["session"] for i in made.search("lantern", project, start="2024-01-03").items} == {second}
    assert {i["session"] for i in made.search("lantern", project, end="2024-01-02T23").items} == {first}
    assert {i["session"] for i in made.search("lantern", project, branch="side").items} == {second}
    assert made.search("lantern", project, branch="none").status == "empty"
    assert {i["session"] for i in made.search("lantern", project, paths=["SRC/app/lantern.py"]).items} == {first}
    assert made.search("absentword", project).status == "empty"
    latest = made.search("latest lantern", project | {"session_id": second})
    assert {i["type"] for i in latest.items} == {"chunk", "session_synopsis"}  # no text holds both words: structured and recent ones
    why = made.search("why red cache", project)
    assert why.extra["intent"] == "decision_rationale" and {i["type"] for i in why.items} == {"decision"}
    for wrong in ("", "\x01", "x" * 3000, "w " * 40):
        with pytest.raises(EngineError):
            made.search(wrong, project)
    with pytest.raises(EngineError):
        made.search("lantern", project, types=["thought"])
    page = made.search("lantern", project, limit=1)
    again = made.search(" lantern ", project, limit=1, cursor=page.cursor)
    assert page.status == "partial" and again.items[0]["id"] != page.items[0]["id"]
    # What changed since it was indexed is not found until it is indexed again.
    old = made.t.chunks
    made.t.chunks = old.withColumn("fingerprint", F.lit("other"))
    assert all(i["type"] != "chunk" for i in made.search("lantern", project).items)
    made.t.chunks = old
    assert {r.change for r in made.reindex(spark.createDataFrame([(first,)], "session_id string")).collect()} == {"unchanged"}
    assert {i["id"] for i in made.search("lantern", project).items} == {i["id"] for i in found.items}
    with pytest.raises(ValueError):  # another state of the index
        made.search("lantern", project, limit=1, cursor=page.cursor)
