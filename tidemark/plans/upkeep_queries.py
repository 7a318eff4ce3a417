"""Registered queries over upkeep that follows links, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forget, registry
from tidemark.operators import memory_sync as memory_upkeep
from tidemark.plans.queries import Read, query
from tidemark.sources import rollouts

_TABLES_SQL = (
    "WITH s AS (SELECT c_custkey AS session_id, n_regionkey AS project, n_nationkey AS workstream FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "g AS (SELECT session_id FROM s WHERE project = 1 AND workstream % 2 = 1), "
    "e AS (SELECT o_orderkey AS event_id, o_custkey AS session_id, o_custkey || '/' || o_orderpriority AS chunk_id, (o_custkey % 40) || '/' || o_orderstatus AS memory_id FROM orders), "
    "de AS (SELECT event_id FROM e WHERE session_id IN (SELECT session_id FROM g)), dc AS (SELECT DISTINCT chunk_id FROM e WHERE event_id IN (SELECT event_id FROM de)), "
    "v AS (SELECT DISTINCT memory_id, chunk_id FROM e), vl AS (SELECT * FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM dc)), "
    "o AS (SELECT l_partkey AS object_id, l_orderkey AS event_id FROM lineitem WHERE l_linenumber = 1), ol AS (SELECT * FROM o WHERE event_id NOT IN (SELECT event_id FROM de)) "
)


@query(
    _TABLES_SQL + "SELECT 'events' AS name, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS links FROM e WHERE event_id NOT IN (SELECT event_id FROM de) UNION ALL "
    "SELECT 'chunks', count(DISTINCT chunk_id), count(*) FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM dc) UNION ALL "
    "SELECT 'memories', count(DISTINCT memory_id), count(*) FROM vl UNION ALL SELECT 'gone_chunks', count(*), 0 FROM dc UNION ALL "
    "SELECT 'gone_objects', count(*), CAST(coalesce(sum(object_id), 0) AS BIGINT) FROM (SELECT DISTINCT object_id FROM o WHERE object_id NOT IN (SELECT object_id FROM ol))"
)
def forget_cascade(read: Read) -> DataFrame:
    """A workstream's sessions are forgotten: what is left of each table, and of the links between them."""
    sessions = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("string").alias("project_id"), (F.col("n_nationkey") % 2).cast("string").alias("workstream_id"), F.col("c_custkey").alias("session_id")
    )
    gone = forget.sessions_within(sessions, {"project_id": "1", "workstream_id": "1"})
    key = F.col("o_custkey")
    events = read("orders").select(
        F.col("o_orderkey").alias("event_id"), key.alias("session_id"), F.concat_ws("/", key.cast("string"), "o_orderpriority").alias("chunk_id"),
        F.concat_ws("/", (key % 40).cast("string"), "o_orderstatus").alias("memory_id"),
    )
    chunks = events.groupBy("chunk_id", "session_id").agg(F.collect_list("event_id").alias("event_ids"))
    # Memories of projects: of no session of their own.
    memories = events.groupBy("memory_id").agg(F.collect_set("chunk_id").alias("evidence_ids")).withColumn("session_id", F.lit(None).cast("long"))
    links = read("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("object_id"), F.col("l_orderkey").alias("event_id"))
    left = forget.cascade(gone, events.select("event_id", "session_id"), chunks, memories, links)
    told = lambda name, df, n: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("links"))
    return (
        told("events", left.events, F.col("event_id"))
        .unionByName(told("chunks", left.chunks, F.size("event_ids")))
        .unionByName(told("memories", left.memories, F.size("evidence_ids")))
        .unionByName(told("gone_chunks", left.gone_chunks, F.lit(0)))
        .unionByName(told("gone_objects", left.gone_objects, F.col("object_id")))
    )


_RECORDS = (
    ('{"type":"session_meta","payload":{"id":"@"}}', "accepted", None),
    ('{"type":"response_item","payload":{"type":"message","role":"user","content":"said @"}}', "accepted", None),
    ('{"type":"response_item","payload":{"type":"message","role":"system","content":"said @"}}', "ignored", "forbidden_role"),
    ('{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"image","url":"@"}]}}', "ignored", "unsupported_content"),
    ('{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"image"},{"type":"text","text":"@"}]}}', "accepted", None),
    ('{"type":"response_item","payload":{"type":"function_call","name":"@","arguments":{"n":1}}}', "accepted", None),
    ('{"type":"response_item","payload":{"type":"function_call","arguments":"@"}}', "failed", "INVALID_RECORD"),
    ('{"type":"response_item","payload":{"type":"function_call_output","call_id":"@"}}', "failed", "INVALID_RECORD"),
    ('{"type":"response_item","payload":{"type":"function_call_output","output":null,"call_id":"@"}}', "accepted", None),
    ('{"type":"event_msg","payload":{"type":"user_message","message":7,"text":"@"}}', "accepted", None),
    ('{"type":"event_msg","payload":{"type":"agent_message","message":7}}', "failed", "INVALID_RECORD"),
    ('{"type":"event_msg","payload":{"type":"item_completed","item":"@"}}', "ignored", "mirror_record"),
    ('{"type":"turn_context","payload":{"x":"@"}}', "ignored", "internal_record"),
    ('{"type":"@","payload":{}}', "ignored", "unsupported_record"),
    ('{"type":7,"payload":{"x":"@"}}', "failed", "MISSING_TYPE"),
    ('{"type":"session_meta","payload":["@"]}', "failed", "INVALID_RECORD"),
    ('["@"]', "failed", "MISSING_TYPE"),
    ('{"@', "failed", "MALFORMED_JSON"),
    ("", "failed", "EMPTY_LINE"),
)


def _of_record(part: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {chr(39) + r[part] + chr(39) if r[part] else 'NULL'}" for i, r in enumerate(_RECORDS))
    return f"CASE CAST(event_id % {len(_RECORDS)} AS INTEGER) {cases} END"


@query(f"SELECT event_id, {_of_record(1)} AS state, {_of_record(2)} AS reason FROM events")
def payload_faults(read: Read) -> DataFrame:
    """Records of every shape, each holding its event's type: what is accepted, passed over or refused, and why."""
    shapes = F.array(*(F.lit(r[0]) for r in _RECORDS))
    line = F.replace(F.element_at(shapes, (F.col("event_id") % len(_RECORDS) + 1).cast("int")), F.lit("@"), F.col("event_type"))
    rows = read("events").select("event_id", line.alias("line")).withColumn("v", F.try_parse_json("line"))
    return rows.select("event_id", rollouts.judged(F.col("line"), F.col("v")).alias("j")).select("event_id", "j.state", "j.reason")


_SOURCES_SQL = (
    "WITH k AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderkey % 2 = 0 THEN 'rollout' ELSE 'history' END AS kind FROM orders), "
    "b AS (SELECT 'f' || k AS path, kind, 1 AS device, k AS inode, size, CAST(0 AS DOUBLE) AS modified_at, size - k % 4 AS committed_offset FROM k WHERE k % 3 <> 0), "
    "a0 AS (SELECT CASE WHEN k % 11 = 0 THEN 'g' ELSE 'f' END || k AS path, kind, CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END AS device, k AS inode, "
    "CASE WHEN k % 19 = 0 THEN -1 WHEN k % 7 = 0 THEN size + 5 WHEN k % 7 = 1 THEN size - 5 ELSE size END AS size, CAST(CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS modified_at FROM k WHERE k % 5 <> 0), "
    "bad AS (SELECT path FROM a0 WHERE size < 0), a AS (SELECT * FROM a0 WHERE size >= 0), bb AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM bad)), "
    "lost AS (SELECT * FROM bb WHERE path NOT IN (SELECT path FROM a)), fresh AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM bb)), "
    "moved AS (SELECT fresh.*, lost.path AS moved_from, lost.committed_offset FROM fresh JOIN lost USING (kind, device, inode)), "
    "same AS (SELECT a.*, bb.committed_offset, CASE WHEN a.device <> bb.device OR a.inode <> bb.inode THEN 'rotated' WHEN a.size < bb.size THEN 'truncated' WHEN a.size > bb.size THEN 'appended' "
    "WHEN a.modified_at <> bb.modified_at THEN 'touched' ELSE 'unchanged' END AS change FROM a JOIN bb USING (path)), "
    "folded AS (SELECT path, kind, device, inode, size, modified_at, CASE WHEN change IN ('rotated', 'truncated') THEN 0 ELSE committed_offset END AS committed_offset, "
    "CASE WHEN change = 'rotated' THEN 2 ELSE 1 END AS first_seen_at, 2 AS last_seen_at, change, NULL AS moved_from FROM same "
    "UNION ALL SELECT path, kind, device, inode, size, modified_at, committed_offset, 1, 2, 'moved', moved_from FROM moved "
    "UNION ALL SELECT path, kind, device, inode, size, modified_at, 0, 2, 2, 'new', NULL FROM fresh WHERE path NOT IN (SELECT path FROM moved) "
    "UNION ALL SELECT path, kind, device, inode, size, modified_at, committed_offset, 1, 1, 'missing', NULL FROM lost WHERE path NOT IN (SELECT moved_from FROM moved) "
    "UNION ALL SELECT path, kind, device, inode, size, modified_at, committed_offset, 1, 1, 'faulty', NULL FROM b WHERE path IN (SELECT path FROM bad)) "
)


def _folded(read: Read) -> DataFrame:
    """Orders as files: some grow, shrink, move, are replaced, touched, lost, new or of invalid size in the second run."""
    key, size = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    kind = F.when(key % 2 == 0, "rollout").otherwise("history").alias("kind")
    orders = read("orders")
    known = orders.filter(key % 3 != 0).select(
        F.concat(F.lit("f"), key.cast("string")).alias("path"), kind, F.lit(1).alias("device"), key.alias("inode"), size.alias("size"), F.lit(0.0).alias("modified_at"),
        (size - key % 4).alias("committed_offset"), F.lit(1).alias("first_seen_at"), F.lit(1).alias("last_seen_at"),
    )
    seen = orders.filter(key % 5 != 0).select(
        F.concat(F.when(key % 11 == 0, "g").otherwise("f"), key.cast("string")).alias("path"), kind, F.when(key % 13 == 0, 2).otherwise(1).alias("device"), key.alias("inode"),
        F.when(key % 19 == 0, -1).when(key % 7 == 0, size + 5).when(key % 7 == 1, size - 5).otherwise(size).alias("size"),
        F.when(key % 17 == 0, 1.0).otherwise(0.0).alias("modified_at"),
    )
    return registry.fold(known, seen, F.lit(2))


@query(_SOURCES_SQL + "SELECT * FROM folded")
def source_registry(read: Read) -> DataFrame:
    return _folded(read)


@query(
    _SOURCES_SQL + "SELECT kind, change, count(*) AS sources, CAST(sum(CASE WHEN change IN ('missing', 'faulty') THEN 0 ELSE greatest(size - committed_offset, 0) END) AS BIGINT) AS bytes_to_read "
    "FROM folded GROUP BY 1, 2"
)
def ingestion_runs(read: Read) -> DataFrame:
    return registry.run_totals(_folded(read))


@query(
    "WITH c AS (SELECT c_custkey AS source_id, c_custkey % 3 AS fingerprint, CAST(2000 + c_custkey % 500 AS BIGINT) AS committed_offset, c_name AS line_hash, CAST(0 AS BIGINT) AS written_at FROM customer WHERE c_custkey % 4 <> 0), "
    "p AS (SELECT * FROM (SELECT o_custkey AS source_id, o_custkey % 3 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS fingerprint, CAST(o_orderkey % 5000 AS BIGINT) AS committed_offset, "
    "o_orderpriority AS line_hash, o_orderkey AS written_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders) AS t WHERE place = 1) "
    "SELECT source_id, p.fingerprint, p.committed_offset, p.line_hash, p.written_at, 'written' AS outcome FROM p LEFT JOIN c USING (source_id) "
    "WHERE c.source_id IS NULL OR p.fingerprint <> c.fingerprint OR p.committed_offset >= c.committed_offset UNION ALL "
    "SELECT source_id, c.fingerprint, c.committed_offset, c.line_hash, c.written_at, CASE WHEN p.source_id IS NULL THEN 'kept' ELSE 'refused' END FROM c LEFT JOIN p USING (source_id) "
    "WHERE p.source_id IS NULL OR (p.fingerprint = c.fingerprint AND p.committed_offset < c.committed_offset)"
)
def cursor_advance(read: Read) -> DataFrame:
    """Cursors of sources against the last order of each: written on, refused on the way back, or kept."""
    cust, key = F.col("c_custkey"), F.col("o_orderkey")
    cursors = read("customer").filter(cust % 4 != 0).select(
        cust.alias("source_id"), (cust % 3).alias("fingerprint"), (2000 + cust % 500).cast("long").alias("committed_offset"), F.col("c_name").alias("line_hash"), F.lit(0).cast("long").alias("written_at")
    )
    proposals = read("orders").select(
        F.col("o_custkey").alias("source_id"), (F.col("o_custkey") % 3 + F.when(key % 5 == 0, 1).otherwise(0)).alias("fingerprint"),
        (key % 5000).cast("long").alias("committed_offset"), F.col("o_orderpriority").alias("line_hash"), key.cast("long").alias("written_at"),
    )
    return registry.advance(cursors, proposals)


def _user_memories(events: DataFrame, at: str) -> DataFrame:
    """A memory for each session and type of event: how many there are and what they come to."""
    told = F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.sum("event_id").cast("string"))
    return events.groupBy("session_id", "event_type").agg(told.alias("body")).select(
        F.concat_ws("/", F.col("session_id").cast("string"), "event_type").alias("memory_id"), "session_id", "body",
        F.when(F.col("event_type") == "error", "extra").otherwise("built-in").alias("extractor_version"), F.lit(at).alias("derived_at"), F.lit(at).alias("updated_at"),
    )


_RUN_SQL = (
    "SELECT user_id || '/' || event_type AS memory_id, CAST(user_id AS BIGINT) AS session_id, count(*) || '/' || CAST(sum(event_id) AS BIGINT) AS body, "
    "CASE WHEN event_type = 'error' THEN 'extra' ELSE 'built-in' END AS extractor_version FROM events WHERE user_id IS NOT NULL AND {} GROUP BY user_id, event_type"
)
_FIRST = "(user_id % 3 <> 0 OR event_id % 4 <> 0) AND user_id % 11 <> 0"
_SECOND = "(user_id % 5 <> 0 OR event_id % 3 <> 0) AND user_id % 13 <> 0"


@query(
    f"WITH o AS ({_RUN_SQL.format(_FIRST)}), d AS ({_RUN_SQL.format(_SECOND)}) "
    "SELECT memory_id, d.session_id, d.body, d.extractor_version, CASE WHEN o.memory_id IS NULL THEN 'second' ELSE 'first' END AS derived_at, "
    "CASE WHEN o.memory_id IS NULL THEN 'second' WHEN o.body = d.body THEN 'first' ELSE 'now' END AS updated_at FROM d LEFT JOIN o USING (memory_id) UNION ALL "
    "SELECT memory_id, session_id, body, extractor_version, 'first', 'first' FROM o WHERE extractor_version = 'extra' AND memory_id NOT IN (SELECT memory_id FROM d)"
)
def memory_sync(read: Read) -> DataFrame:
    """Memories after a second run over changed events: as if all were derived, from touched sessions alone."""
    events = read("events").select("event_id", F.col("user_id").cast("long").alias("session_id"), "event_type", "user_id")
    first, second = events.filter(_FIRST), events.filter(_SECOND)
    content = ["event_id", "event_type"]
    known = _user_memories(first, "first")
    sessions = memory_upkeep.touched(memory_upkeep.session_marks(first, content), memory_upkeep.session_marks(second, content))
    found = memory_upkeep.changes(second, sessions, known, lambda e: _user_memories(e, "second"), "now", ["built-in"])
    return memory_upkeep.apply(known, found)
