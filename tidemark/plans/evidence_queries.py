"""Registered queries over packed evidence and sanitised JSON, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import redaction, sanitize, text
from tidemark.operators import retrieval, semantic
from tidemark.plans.queries import Read, query, rounded

_ITEMS, _TOKENS, _BYTES = 4, 400, 1_500
_EVENTS_SQL = (
    "SELECT conv_id AS session_id, turn AS ordinal, conv_id || '/' || turn AS event_id, text, role, CASE WHEN turn % 4 IN (0, 3) THEN 'c' || (turn // 4) END AS tool_call_id, "
    r"len(regexp_extract_all(text, '\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]')) AS tokens, strlen(text) AS bytes FROM conversations"
)
_SHOWN_SQL = (
    f"WITH e AS ({_EVENTS_SQL}), a AS (SELECT session_id AS request_id, session_id, ordinal FROM e WHERE role = 'user' AND ordinal < 3), "
    "n AS (SELECT DISTINCT a.request_id, e.event_id FROM e JOIN a ON e.session_id = a.session_id AND e.ordinal BETWEEN a.ordinal - 1 AND a.ordinal + 1), "
    "p AS (SELECT DISTINCT n.request_id, o.event_id FROM n JOIN e ON e.event_id = n.event_id JOIN e AS o ON o.session_id = e.session_id AND o.tool_call_id = e.tool_call_id), "
    "s AS (SELECT request_id, event_id FROM n UNION SELECT request_id, event_id FROM p), "
    "r AS (SELECT s.request_id, e.event_id, e.ordinal, e.tokens, e.bytes, row_number() OVER w AS place, sum(e.tokens) OVER w AS spent_tokens, sum(e.bytes) OVER w AS spent_bytes "
    "FROM s JOIN e ON e.event_id = s.event_id WINDOW w AS (PARTITION BY s.request_id ORDER BY e.session_id, e.ordinal, e.event_id)), "
    f"f AS (SELECT *, place <= {_ITEMS} AND spent_tokens <= {_TOKENS} AND spent_bytes <= {_BYTES} AS fits FROM r) "
)


def _packed(read: Read) -> tuple[DataFrame, DataFrame]:
    turn = F.col("turn")
    events = read("conversations").select(
        F.col("conv_id").alias("session_id"), turn.alias("ordinal"), F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string")).alias("event_id"), "role", "text",
        F.when((turn % 4).isin(0, 3), F.concat(F.lit("c"), F.floor(turn / 4).cast("string"))).alias("tool_call_id"),
        text.token_count(F.col("text")).alias("tokens"), F.octet_length("text").alias("bytes"),
    )
    anchors = events.filter("role = 'user' and ordinal < 3").select(F.col("session_id").alias("request_id"), F.col("event_id").alias("evidence_id"))
    lost = anchors.select("request_id", F.lit("gone").alias("evidence_id")).distinct()
    shown, summary = retrieval.expand_evidence(events, anchors.union(lost))
    return retrieval.pack_evidence(shown, summary, _ITEMS, _TOKENS, _BYTES)


@query(_SHOWN_SQL + "SELECT request_id, event_id, CAST(place AS INTEGER) AS place, CAST(spent_tokens AS BIGINT) AS spent_tokens, CAST(spent_bytes AS BIGINT) AS spent_bytes FROM f WHERE fits")
def evidence_pack(read: Read) -> DataFrame:
    """Each conversation asks for its first users' turns: neighbours and tool partners, within three budgets."""
    events, _ = _packed(read)
    return events.select("request_id", "event_id", "place", F.col("spent_tokens").cast("long").alias("spent_tokens"), F.col("spent_bytes").cast("long").alias("spent_bytes"))


@query(
    _SHOWN_SQL + "SELECT request_id, count(*) FILTER (fits) AS items, CAST(coalesce(sum(tokens) FILTER (fits), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(bytes) FILTER (fits), 0) AS BIGINT) AS bytes, "
    f"concat_ws(',', CASE WHEN max(place) > {_ITEMS} THEN 'items' END, CASE WHEN sum(tokens) FILTER (place <= {_ITEMS}) > {_TOKENS} THEN 'tokens' END, CASE WHEN sum(bytes) FILTER (place <= {_ITEMS}) > {_BYTES} THEN 'bytes' END) AS limits, "
    "'gone' AS unavailable FROM f GROUP BY request_id"
)
def evidence_limits(read: Read) -> DataFrame:
    """What each of these requests spent, which budgets it went beyond, and which ids it did not find."""
    _, spent = _packed(read)
    return spent.select("request_id", "items", "tokens", "bytes", F.array_join("limits", ",").alias("limits"), F.array_join("unavailable", ",").alias("unavailable"))


_DEEP = "[" * 40 + "1" + "]" * 40
_CANONICAL_SQL = (
    f"'{{\"note\":\"{redaction.PLACEHOLDER} ' || event_type || '\",\"where\":[\"[LOCAL_PATH]\",{{\"a\":[null,true,1.25,3],\"z\":\"' || event_type || '\"}}],\"with\":' || replace(props, ' ', '') || '}}'"
)


@query(
    f"SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN {_CANONICAL_SQL} END AS json, "
    "CASE WHEN event_id % 5 = 0 THEN 'MALFORMED_JSON' WHEN event_id % 7 = 0 THEN 'TOO_DEEP' WHEN event_id % 11 = 0 THEN 'KEY_COLLISION' END AS fault FROM events"
)
def sanitize_json(read: Read) -> DataFrame:
    """Nested values around every event's properties: a secret, a local path, and some that cannot be shown."""
    rest = F.concat(F.lit(', "note": "password=hunter2hunter '), F.col("event_type"), F.lit('", "where": ["/home/me/x.txt", {"z": "'), F.col("event_type"), F.lit('", "a": [null, true, 1.25, 3.0]}]}'))
    whole = F.concat(F.lit('{ "with": '), F.col("props"), rest)
    twice = F.lit('{"/home/a": 1, "/home/b": 2}')
    key = F.col("event_id")
    value = F.when(key % 5 == 0, F.lit("{broken")).when(key % 7 == 0, F.lit(_DEEP)).when(key % 11 == 0, twice).otherwise(whole)
    return read("events").select("event_id", sanitize.sanitize_json(value).alias("s")).select("event_id", "s.json", "s.fault")


@query(
    "WITH v AS (SELECT vec_id, vec_id // 2 AS entity_id, 's' || (vec_id % 3) AS space_id, 'p' || label AS project_id, format('2024-{:02d}', vec_id % 12 + 1) AS observed_at, CASE WHEN vec_id % 4 < 3 THEN 'decision' ELSE 'chunk' END AS type, embedding::DOUBLE[] AS v FROM embeddings), "
    "a AS (SELECT vec_id AS query_id, 'p' || label AS project_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), "
    "d AS (SELECT query_id, entity_id, vec_id, list_distance(v, q) AS distance FROM v JOIN a ON a.project_id = v.project_id WHERE space_id IN ('s0', 's1') AND type = 'decision' AND observed_at >= '2024-03' AND observed_at <= '2024-11'), "
    "e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY distance, vec_id) = 1) "
    "SELECT query_id, entity_id, round(distance, 9) + 0.0 AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM e QUALIFY rank <= 8"
)
def semantic_search(read: Read) -> DataFrame:
    """Every twentieth vector asks inside its own project: spaces, types and times narrow before ranks; an entity has up to two vectors."""
    key = F.col("vec_id")
    project = F.concat(F.lit("p"), F.col("label").cast("string"))
    rows = read("embeddings").select(
        key.alias("vector_id"), F.floor(key / 2).alias("entity_id"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("space_id"), project.alias("project_id"),
        F.format_string("2024-%02d", (key % 12 + 1).cast("int")).alias("observed_at"), F.when(key % 4 < 3, "decision").otherwise("chunk").alias("type"),
        F.col("embedding").cast("array<double>").alias("v"), F.lit("f").alias("fingerprint"),
    )
    among = semantic.narrowed(rows, "s0", None, ["decision"], "2024-03", "2024-11").unionByName(semantic.narrowed(rows, "s1", None, ["decision"], "2024-03", "2024-11"))
    asked = read("embeddings").filter("vec_id % 20 = 0").select(key.alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), project.alias("project_id"))
    found = semantic.nearest_entities(among, asked, "l2", 8, ["project_id"])
    return found.select("query_id", "entity_id", rounded(F.col("distance")).alias("distance"), "rank")
