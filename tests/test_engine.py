from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.plans import engine


def tables(spark):
    rows = []
    for s in (1, 2, 3):
        for i in range(6):
            said = {0: "Decision: use the red cache because it is fast.", 2: "TODO: need to check src/app/main.py.", 4: "We decided to use disk instead of the red cache."}.get(i, f"answer {i} about lantern {s}")
            rows.append((s, i, "user_message" if i % 2 == 0 else "assistant_message", said, f"2024-01-0{i + 1}", f"e{s}{i}", None))
    events = spark.createDataFrame(rows, "session_id long, ordinal long, kind string, text string, observed_at string, event_id string, tool_call_id string")
    scopes = spark.createDataFrame(
        [("project", "p", "Alpha", "p", None), ("project", "q", "Beta", "q", None), *(("session", str(s), f"S{s}", "p" if s < 3 else "q", None) for s in (1, 2, 3))],
        "scope_kind string, scope_id string, name string, project_id string, workstream_id string",
    )
    gone = spark.createDataFrame([], "project_id string, workstream_id string, session_id string, reason string")
    aliases = spark.createDataFrame([("project", "p", "first")], "scope_kind string, scope_id string, alias string")
    return engine.Tables(events, scopes, gone, aliases)


def test_budgets_clamp():
    assert [engine.clamp(v, engine.ITEMS) for v in (999, -1, 500.9, None, math.nan)] == [20, 1, 20, 12, 12]
    assert engine.clamp(500.9, engine.TOKENS) == 500


def test_cursor_is_bound_to_secret_and_request():
    c = engine.encode_cursor(7, "ctx", b"s")
    assert engine.decode_cursor(c, "ctx", b"s") == 7
    for args in ((c, "other", b"s"), (c, "ctx", b"t"), ("junk", "ctx", b"s")):
        with pytest.raises(ValueError):
            engine.decode_cursor(*args)


def test_pack_cuts_snippets_and_skips():
    found, cut = engine.pack([{"id": 1, "snippet": "word " * 500}, {"id": 2, "snippet": "end"}], 5, 300)
    assert cut and len(found[0]["snippet"]) < 2500 and found[0]["id"] == 1


def test_engine_verbs(spark, tmp_path):
    e = engine.Engine(spark, tables(spark))
    e.index(20, 40)
    assert [r.scope_id for r in e.list_scopes("first").collect()] == ["p"]
    found = e.search("lantern", {"project_id": "p"}, limit=3)
    assert found.items and {i["session"] for i in found.items} == {"1", "2"} and found.extra["intent"] == "general"
    if found.cursor:
        again = e.search("lantern", {"project_id": "p"}, limit=3, cursor=found.cursor)
        assert not {i["id"] for i in again.items} & {i["id"] for i in found.items}
    told = e.overview({"project_id": "p"}).collect()
    assert {r.type for r in told} == {"session_synopsis", "decision", "open_item"} and "superseded" in {r.status for r in told}
    evidence = e.get_evidence([found.items[0]["id"]], {"project_id": "p"}).collect()
    assert evidence == sorted(evidence, key=lambda r: r.ordinal)
    shown, spent = e.pack_evidence([found.items[0]["id"], "ku::chunk:none"], {"project_id": "p"}, limit=2)
    rows = shown.collect()
    assert len(rows) == spent["items"] <= 2 and [r.place for r in rows] == list(range(1, len(rows) + 1)) and spent["unavailable"] == ["ku::chunk:none"]
    hidden, nothing = e.pack_evidence([found.items[0]["id"]], {"project_id": "q"})
    assert hidden.collect() == [] and nothing == {"items": 0, "tokens": 0, "bytes": 0, "limits": [], "unavailable": [found.items[0]["id"]]}
    sessions = spark.createDataFrame([(1,)], "session_id long")
    assert {r.change for r in e.reindex(sessions, 20, 40).collect()} == {"unchanged"}
    e.export({"project_id": "p"}, str(tmp_path / "pack"))
    assert spark.read.text(str(tmp_path / "pack")).filter(F.col("value").contains("red cache")).count()
    assert e.forget({"project_id": "none"}, "asked") == "not_found"
    assert e.forget({"project_id": "p", "session_id": "1"}, "asked", "t0", purge=False) == "pending"
    assert {i["session"] for i in e.search("lantern", {"project_id": "p"}).items} == {"2"} and e.t.events.filter("session_id = 1").count() == 6
    assert e.forget({"project_id": "p", "session_id": "1"}, "asked", "t1") == e.forget({"project_id": "p", "session_id": "1"}, "asked", "t2") == "complete"
    assert [tuple(r) for r in e.t.tombstones.select("status", "excluded_at", "updated_at").collect()] == [("deleted", "t0", "t1")]
    for left in (e.t.events, e.t.chunks, e.t.memories):
        assert {r.session_id for r in left.select("session_id").distinct().collect()} == {2, 3}
    assert e.stored.marks().count() == e.t.chunks.count() + e.t.memories.count()
    e.forget({"project_id": "p"}, "asked")
    assert e.search("lantern", {"project_id": "p"}).status == "excluded"
    assert e.search("lantern", {"project_id": "q"}).items
