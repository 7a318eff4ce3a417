"""Registered queries over synopses, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import memory, synopsis
from tidemark.plans.queries import _SENTENCE_SQL, Read, _said, query

_LAST = {0: "It must stay small", 1: "We decided on src/main.ts", 2: "TODO remaining work", 3: "An error came up", 4: "Nothing"}
_CASE = "CASE CAST((conv_id + turn) % 5 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _LAST.items()) + " END"
_LABEL = "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END"
_CHUNKS_SQL = (
    "SELECT conv_id AS session_id, format('{:08d}', turn) AS chunk_id, coalesce(text, '') AS said, role, "
    f"{_LABEL} || ':' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Tool result:' || chr(10) || {_CASE} AS display_text FROM conversations"
)


def _chunks(read: Read) -> DataFrame:
    last = F.create_map(*(F.lit(x) for kv in _LAST.items() for x in kv))[((F.col("conv_id") + F.col("turn")) % 5).cast("int")]
    label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    number = F.format_string("%08d", F.col("turn"))
    shown = F.concat(label, F.lit(":\n"), F.coalesce("text", F.lit("")), F.lit("\n\nTool result:\n"), last)
    return read("conversations").select(F.col("conv_id").alias("session_id"), number.alias("chunk_id"), number.alias("observed_from"), number.alias("observed_to"), shown.alias("display_text"))


_SPACES = r"regexp_replace(e, '\s+', ' ', 'g')"
_LINE_SQL = " UNION ALL ".join(
    f"SELECT session_id, '{name}' AS name, chunk_id, no, e FROM l WHERE regexp_matches(e, '{pattern.replace(chr(39), chr(39) * 2)}')" for name, pattern in synopsis.LINES.items()
)
_SECTIONS_SQL = (
    f"WITH c AS ({_CHUNKS_SQL}), s AS (SELECT session_id, chunk_id, unnest(range(1, len(p) + 1)) AS no, p FROM (SELECT *, string_split(display_text, chr(10)) AS p FROM c)), "
    "l AS (SELECT session_id, chunk_id, no, trim(p[no]) AS e FROM s WHERE trim(p[no]) <> ''), "
    "b AS (SELECT session_id, chunk_id, 0 AS no, trim(said) AS e, role = 'user' AS asked, "
    "row_number() OVER (PARTITION BY session_id, role = 'user' ORDER BY chunk_id) AS up, row_number() OVER (PARTITION BY session_id, role = 'user' ORDER BY chunk_id DESC) AS down FROM c WHERE trim(said) <> ''), "
    "r AS (SELECT session_id, chunk_id, 0 AS no, display_text AS e, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id DESC) AS down FROM c), "
    "x AS (SELECT session_id, 'goal' AS name, chunk_id, no, e FROM b WHERE asked AND up <= 2 UNION ALL SELECT session_id, 'current_state', chunk_id, no, e FROM b WHERE NOT asked AND down <= 3 "
    f"UNION ALL SELECT session_id, 'recent_changes', chunk_id, no, e FROM r WHERE down <= 3 UNION ALL {_LINE_SQL}), "
    f"f AS (SELECT session_id, name, trim({_SPACES}) AS e, min((chunk_id, no)) AS place FROM x GROUP BY 1, 2, 3), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY session_id, name ORDER BY place) AS n FROM f WHERE e <> ''), "
    "u AS (SELECT *, 1200 - coalesce(sum(CASE WHEN length(e) <= 1200 THEN length(e) ELSE length(rtrim(substr(e, 1, 1199))) + 1 END + 1) OVER (PARTITION BY session_id, name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS room FROM n WHERE n <= 5), "
    "t AS (SELECT *, CASE WHEN length(e) <= room THEN e WHEN room = 1 THEN substr(e, 1, 1) ELSE rtrim(substr(e, 1, CAST(room - 1 AS BIGINT))) || '…' END AS cut FROM u WHERE room > 0) "
    "SELECT session_id, name, string_agg(cut, chr(10) ORDER BY n) AS section, string_agg(place[1], ',' ORDER BY n) AS evidence FROM t GROUP BY 1, 2"
)


@query(_SECTIONS_SQL)
def synopsis_sections(read: Read) -> DataFrame:
    return synopsis.sections(_chunks(read)).select("session_id", "name", "section", F.array_join("evidence_ids", ",").alias("evidence"))


_RANK = "CASE name " + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(synopsis.SECTIONS)) + " END"


@query(
    f"SELECT session_id, string_agg(upper(name[1]) || replace(name[2:], '_', ' ') || chr(10) || section, chr(10) || chr(10) ORDER BY {_RANK}) AS body, "
    f"min(o.seen_from) AS observed_from, min(o.seen_to) AS observed_to FROM ({_SECTIONS_SQL}) JOIN "
    "(SELECT conv_id, format('{:08d}', min(turn)) AS seen_from, format('{:08d}', max(turn)) AS seen_to FROM conversations GROUP BY 1) o ON conv_id = session_id GROUP BY session_id"
)
def synopsis_memories(read: Read) -> DataFrame:
    return synopsis.synopses(_chunks(read)).select("session_id", "body", "observed_from", "observed_to")


@query(f"SELECT session_id, chunk_id, CASE WHEN role = 'user' THEN trim(said) ELSE '' END AS asked, CASE WHEN role = 'user' THEN '' ELSE trim(said) END AS answered FROM ({_CHUNKS_SQL})")
def labelled_blocks(read: Read) -> DataFrame:
    def of(label: str):
        return F.array_join(synopsis.labelled_blocks(F.col("display_text"), label), "|")

    return _chunks(read).select("session_id", "chunk_id", of("User").alias("asked"), of("Assistant").alias("answered"))


_FLAT = r"trim(regexp_replace(sentence, '\s+', ' ', 'g'))"


@query(
    f"WITH s AS ({_SENTENCE_SQL}), d AS (SELECT session_id, chunk_id, no FROM s WHERE regexp_matches(sentence, '(?i)^(User: )?(decision\\s*:|(we\\s+)?decided|we\\s+(choose|chose|selected|agreed)|(we\\s+)?will\\s+use\\s)')), "
    f"c AS (SELECT session_id, chunk_id, no, {_FLAT} AS f, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY no) AS n FROM s WHERE regexp_matches(sentence, '(?i)\\b(must|cannot|can''t|required?|constraint)\\b')), "
    "g AS (SELECT session_id, chunk_id, string_agg(CASE WHEN length(f) <= 300 THEN f ELSE rtrim(substr(f, 1, 299)) || '…' END, '|' ORDER BY no) AS constraints FROM c WHERE n <= 8 GROUP BY 1, 2) "
    "SELECT d.session_id, d.chunk_id, d.no, coalesce(constraints, '') AS constraints FROM d LEFT JOIN g ON d.session_id = g.session_id AND d.chunk_id = g.chunk_id"
)
def decision_constraints(read: Read) -> DataFrame:
    return memory.decisions(_said(read)).select("session_id", "chunk_id", "no", F.array_join("constraints", "|").alias("constraints"))
