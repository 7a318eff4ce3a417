"""Registered queries over sessions, sources and runs, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normalize
from tidemark.operators import filters, memory, runs, sessions
from tidemark.plans.queries import Read, query

_ISO = "yyyy-MM-dd'T'HH:mm:ss'.000Z'"
_ISO_SQL = "'%Y-%m-%dT%H:%M:%S.000Z'"

_SESSIONS_SQL = (
    "SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS title, c_mktsegment AS branch, CAST(NULL AS VARCHAR) AS head_commit, "
    f"strftime(min(o_orderdate), {_ISO_SQL}) AS started_at, strftime(max(o_orderdate), {_ISO_SQL}) AS last_activity_at, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'available' ELSE 'selected' END AS availability, min(r_name) AS project_name "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment"
)


def _session_rows(read: Read) -> DataFrame:
    times = read("orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), _ISO).alias("started_at"), F.date_format(F.max("o_orderdate"), _ISO).alias("last_activity_at"))
    named = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.join(times, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").cast("string").alias("session_id"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("title"),
        F.col("c_mktsegment").alias("branch"),
        F.lit(None).cast("string").alias("head_commit"),
        "started_at",
        "last_activity_at",
        F.when(F.col("c_custkey") % 5 == 0, "available").otherwise("selected").alias("availability"),
        F.col("r_name").alias("project_name"),
    )


_TITLE_SQL = "coalesce(title, 'Codex session' || coalesce(' · ' || substr(coalesce(last_activity_at, started_at), 1, 10), '') || coalesce(' · ' || branch, ''))"


@query(
    f"SELECT session_id, 'tidemark://sessions/' || session_id AS uri, {_TITLE_SQL} AS title, concat_ws(' · ', project_name, branch, substr(last_activity_at, 1, 10)) AS subtitle, "
    f"last_activity_at AS last_modified FROM ({_SESSIONS_SQL}) WHERE availability = 'selected' AND (lower(session_id) LIKE '%build%' OR lower(title) LIKE '%build%' OR lower(branch) LIKE '%build%') "
    "ORDER BY coalesce(last_activity_at, '') DESC, session_id LIMIT 20"
)
def session_references(read: Read) -> DataFrame:
    return sessions.references(_session_rows(read), " Build ")


@query(f"SELECT session_id, {_TITLE_SQL} AS title, 'tidemark://sessions/' || session_id AS uri FROM ({_SESSIONS_SQL})")
def session_titles(read: Read) -> DataFrame:
    rows = _session_rows(read)
    title = normalize.session_title(F.col("title"), F.col("last_activity_at"), F.col("started_at"), F.col("branch"))
    return rows.select("session_id", title.alias("title"), normalize.session_uri(F.col("session_id")).alias("uri"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS session_id, coalesce(t.title, c_name) AS title FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS title FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) t ON o_custkey = c_custkey"
)
def title_enrichment(read: Read) -> DataFrame:
    known = read("customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_name").alias("title"))
    told = read("orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("title"))
    return sessions.enrich_titles(known, told)


@query(
    "SELECT c_custkey, CASE WHEN length(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))) BETWEEN 1 AND 256 AND c_custkey % 4 <> 0 THEN lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))) END AS alias, "
    "CASE WHEN c_custkey % 4 <> 0 THEN sha256(lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g')))) END AS alias_key FROM customer"
)
def alias_normalize(read: Read) -> DataFrame:
    """Every fourth alias holds a control character and is refused."""
    given = F.concat("c_name", F.when(F.col("c_custkey") % 4 == 0, "\x07 ").otherwise("  "), "c_mktsegment")
    return read("customer").select("c_custkey", normalize.alias(given).alias("alias")).withColumn("alias_key", F.sha2("alias", 256))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 6 <> 0 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) BETWEEN 1 AND 2048 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS asked FROM documents"
)
def query_normalize(read: Read) -> DataFrame:
    """Whole texts as queries: too long ones and every sixth, which holds a control character, are refused."""
    given = F.concat(F.col("text"), F.when(F.col("doc_id") % 6 == 0, "\x0b").otherwise(""))
    return read("documents").select("doc_id", normalize.search_query(given).alias("asked"))


@query(
    "SELECT c_custkey, c_nationkey, place FROM (SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, sha256(lower(c_name))) AS INTEGER) AS place FROM customer) WHERE place <= 8"
)
def alias_order(read: Read) -> DataFrame:
    rows = read("customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("alias"), F.col("c_acctbal").alias("created_at"))
    return sessions.latest_aliases(sessions.alias_rows(rows), "c_nationkey", 8).select("c_custkey", "c_nationkey", "place")


_URLS = {
    0: "https://user:secret@Git.Example.org/team/repo.git", 1: "git@Example.org:team/repo.git", 2: "ssh://git@example.org:22/x", 3: "ftp://example.org/x",
    4: "https://example.org/x?token=1", 5: "https://example.org", 6: "not an address",
}
_URL_SQL = {0: "'https://git.example.org/team/repo.git'", 1: "'example.org:team/repo.git'", 2: "'ssh://example.org:22/x'", 5: "'https://example.org/'"}


@query(
    f"SELECT o_orderkey, CASE CAST(o_orderkey % 7 AS INTEGER) {' '.join(f'WHEN {k} THEN {v}' for k, v in _URL_SQL.items())} END AS repository_url, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) END AS commit_hash FROM orders"
)
def git_metadata(read: Read) -> DataFrame:
    url = F.create_map(*(F.lit(x) for kv in _URLS.items() for x in kv))[(F.col("o_orderkey") % 7).cast("int")]
    digest = F.upper(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 40))
    given = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("z"), digest)).otherwise(digest)
    return read("orders").select("o_orderkey", normalize.repository_url(url).alias("repository_url"), normalize.commit_hash(given).alias("commit_hash"))


@query(
    "SELECT kind, id, CASE WHEN kind = 'project' THEN id ELSE p END AS project_id, CASE kind WHEN 'workstream' THEN id WHEN 'session' THEN w END AS workstream_id, CASE WHEN kind = 'session' THEN id END AS session_id, "
    "CASE WHEN kind = 'session' THEN coalesce(name, id) ELSE name END AS name FROM (SELECT 'project' AS kind, 'r' || r_regionkey AS id, NULL AS p, NULL AS w, r_name AS name FROM region "
    "UNION ALL SELECT 'workstream', 'n' || n_nationkey, 'r' || n_regionkey, NULL, n_name FROM nation UNION ALL SELECT 'session', 'c' || c_custkey, 'r' || n_regionkey, 'n' || n_nationkey, "
    "CASE WHEN c_custkey % 2 = 0 THEN c_name END FROM customer JOIN nation ON c_nationkey = n_nationkey)"
)
def scope_addresses(read: Read) -> DataFrame:
    none = F.lit(None).cast("string")
    r, n, c = (F.concat(F.lit(x), F.col(k).cast("string")) for x, k in (("r", "r_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey")))
    region_of = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    rows = read("region").select(F.lit("project").alias("kind"), r.alias("id"), none.alias("p"), none.alias("w"), F.col("r_name").alias("name"))
    rows = rows.unionByName(read("nation").select(F.lit("workstream").alias("kind"), n.alias("id"), region_of.alias("p"), none.alias("w"), F.col("n_name").alias("name")))
    placed = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.unionByName(placed.select(F.lit("session").alias("kind"), c.alias("id"), region_of.alias("p"), n.alias("w"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name")))
    address = normalize.scope_address(F.col("kind"), F.col("id"), F.col("p"), F.col("w"))
    return rows.select("kind", "id", address.alias("a"), normalize.scope_name(F.col("kind"), F.col("id"), F.col("name")).alias("name")).select("kind", "id", "a.*", "name")


@query(
    "WITH b AS (SELECT n_nationkey AS k, n_name AS name, 0 AS t, 0 AS new FROM nation UNION ALL SELECT c_nationkey, c_name, c_custkey, 1 FROM customer WHERE c_custkey % 10 = 0) "
    "SELECT k, arg_max(name, (new, t)) AS name, arg_min(t, (new, t)) AS created_at FROM b GROUP BY k"
)
def scope_upsert(read: Read) -> DataFrame:
    old = read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("created_at"))
    new = read("customer").filter("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("t"), F.col("c_custkey").alias("created_at"))
    return sessions.upsert(old, new, ["k"], "t", kept=("created_at",)).select("k", "name", "created_at")


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)")
def scope_orphans(read: Read) -> DataFrame:
    return sessions.orphans(read("nation").select("n_nationkey", "n_regionkey"), read("region").filter("r_regionkey % 2 = 0"), "n_regionkey", "r_regionkey")


@query(
    "SELECT conv_id, CAST(count(*) FILTER (WHERE conv_id % 4 IN (1, 2)) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE conv_id % 4 NOT IN (1, 2)) AS BIGINT) AS skipped FROM conversations GROUP BY conv_id"
)
def ingestion_scope(read: Read) -> DataFrame:
    events = read("conversations").select(F.col("conv_id").alias("session_id"))
    known = events.distinct().filter("session_id % 4 != 3").select("session_id", F.when(F.col("session_id") % 4 == 0, "excluded").otherwise("selected").alias("availability"))
    counted = sessions.accepted_events(events, known).groupBy(F.col("session_id").alias("conv_id"))
    return counted.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("skipped"))


@query("SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) AS modified_at_ms FROM orders ORDER BY modified_at_ms DESC, CAST(o_orderkey AS VARCHAR) LIMIT 64")
def source_priority(read: Read) -> DataFrame:
    rows = read("orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_at_ms"), F.col("o_orderkey").cast("string").alias("normalized_path"))
    return runs.prioritized(rows).select("o_orderkey", "modified_at_ms")


@query(
    "WITH s AS (SELECT p_partkey, CAST(p_size * 100 AS BIGINT) AS size, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size * 100 AS BIGINT) - p_partkey % 2 * 50 END AS done FROM part) "
    "SELECT p_partkey AS source_id, size AS size_bytes, coalesce(done, 0) AS indexed_bytes, greatest(0, size - coalesce(done, 0)) AS lag_bytes, "
    "CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN done IS NULL THEN 'not_indexed' WHEN done < size THEN 'stale' ELSE 'current' END AS status FROM s"
)
def source_health(read: Read) -> DataFrame:
    every = read("part").select(F.col("p_partkey").alias("source_id"), (F.col("p_size") * 100).cast("long").alias("size"))
    cursors = every.filter("source_id % 3 != 0").select("source_id", (F.col("size") - F.col("source_id") % 2 * 50).alias("committed"))
    return runs.health(every.filter("source_id % 7 != 0"), every, cursors)


_RUN_SQL = (
    "SELECT o_custkey, count(*) AS discovered, count(*) FILTER (WHERE o_orderstatus <> 'P') AS attempted, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, "
    "count(*) FILTER (WHERE o_orderkey % 4 = 0) AS lagging, bool_or(o_orderkey % 9 = 0) AS part FROM orders GROUP BY 1"
)


@query(
    f"WITH r AS ({_RUN_SQL}), s AS (SELECT *, CASE WHEN discovered = 0 THEN 'no_source' WHEN failed = attempted THEN 'failed' WHEN failed > 0 OR lagging > 0 THEN 'partial' ELSE 'ok' END AS run_status FROM r) "
    "SELECT o_custkey, run_status, CASE WHEN run_status = 'failed' THEN 'failed' WHEN run_status = 'partial' OR part THEN 'partial' ELSE 'ok' END AS status FROM s"
)
def index_status(read: Read) -> DataFrame:
    counts = read("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("o_orderstatus") != "P").alias("attempted"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"),
        F.count_if(F.col("o_orderkey") % 4 == 0).alias("lagging"), F.bool_or(F.col("o_orderkey") % 9 == 0).alias("part"),
    )
    told = counts.withColumn("run_status", runs.run_status(F.col("discovered"), F.col("attempted"), F.col("failed"), F.col("lagging")))
    return told.select("o_custkey", "run_status", runs.index_status(F.col("run_status"), F.col("discovered"), F.col("part")).alias("status"))


@query("SELECT p_partkey, CAST(least(300000, 1000 * pow(2, least(p_size - 1, 20))) AS BIGINT) AS delay_ms, 5000 < least(300000, 1000 * pow(2, least(p_size - 1, 20))) AS deferred FROM part")
def backoff(read: Read) -> DataFrame:
    delay = runs.backoff_ms(F.col("p_size"))
    return read("part").select("p_partkey", delay.alias("delay_ms"), runs.deferred(delay, F.lit(5000)).alias("deferred"))


@query(
    "SELECT o_custkey AS entity_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS desired_fingerprint FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1"
)
def job_desires(read: Read) -> DataFrame:
    rows = read("orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.lit("chunk").alias("entity_kind"), F.col("o_custkey").alias("entity_id"), F.lit("s").alias("space_id"),
        F.col("o_orderpriority").alias("desired_fingerprint"), F.lit("upsert").alias("operation"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"), F.col("o_orderdate").alias("created_at"),
    )
    _, desires = runs.enqueue(rows.filter("job_id % 2 = 0"), rows.filter("job_id % 2 = 1"))
    return desires.select("entity_id", "desired_fingerprint")


@query(
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-01 00:20:00' AND lower(props) LIKE '%\"k\": 1%' AND user_id % 2 = 0"
)
def search_filtered(read: Read) -> DataFrame:
    hits = read("events").select(
        "event_id", "event_type", F.col("event_type").alias("type"), F.date_format("ts", _ISO).alias("observed_at"), F.col("props").alias("body"), F.col("user_id").alias("session_id")
    )
    branches = read("events").select(F.col("user_id").alias("session_id")).distinct().withColumn("branch", F.when(F.col("session_id") % 2 == 0, "main").otherwise("other"))
    found = filters.narrowed(hits, branches, types=["click", "purchase"], start="2024-01-01T00:20:00.000Z", paths=[' "K": 1', "nowhere/else"], branch="main")
    return found.select("event_id", "event_type")


@query(
    "SELECT o_orderkey, o_orderstatus IN ('F') AS terminal FROM orders"
)
def terminal_states(read: Read) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("candidate")
    return read("orders").select("o_orderkey", filters.is_terminal(state).alias("terminal"))


_BODY = "CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END"


@query(
    f"WITH d AS (SELECT p_partkey AS k, {_BODY} AS body FROM part WHERE p_partkey % 4 <> 0), o AS (SELECT p_partkey AS k, p_name AS body, p_partkey % 3 <> 1 AS owned FROM part WHERE p_partkey % 6 <> 0) "
    "SELECT coalesce(d.k, o.k) AS memory_id, CASE WHEN o.k IS NULL THEN 'insert' WHEN d.k IS NULL THEN 'delete' ELSE 'update' END AS change, "
    "CASE WHEN d.k IS NULL OR o.k IS NOT NULL THEN 'old' ELSE 'new' END AS derived_at FROM d FULL JOIN o ON d.k = o.k WHERE (d.k IS NULL AND o.owned) OR o.k IS NULL OR d.body <> o.body"
)
def memory_diff(read: Read) -> DataFrame:
    part = read("part").select(F.col("p_partkey").alias("memory_id"), "p_name", "p_type")
    desired = part.filter("memory_id % 4 != 0").select("memory_id", F.when(F.col("memory_id") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("body"), F.lit("v").alias("extractor_version"), F.lit("new").alias("derived_at"), F.lit("new").alias("updated_at"))
    old = part.filter("memory_id % 6 != 0").select("memory_id", F.col("p_name").alias("body"), F.when(F.col("memory_id") % 3 != 1, "v").otherwise("user").alias("extractor_version"), F.lit("old").alias("derived_at"), F.lit("old").alias("updated_at"))
    # A version that is not built in is compared as content only where it is wanted again.
    old = old.withColumn("extractor_version", F.when(F.col("memory_id") % 4 != 0, "v").otherwise(F.col("extractor_version")))
    return memory.diff(desired, old, "now", ["v"]).select("memory_id", "change", "derived_at")


@query(
    "SELECT memory_id, place FROM (SELECT p_partkey AS memory_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_partkey % 50 = 0)) WHERE place <= 12"
)
def memories_found(read: Read) -> DataFrame:
    """Memories of given types in each scope, the last updated first."""
    types = read("part").filter("p_partkey % 50 = 0").select("p_type").distinct()
    rows = read("part").join(types, "p_type", "left_semi")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    return rows.select(F.col("p_partkey").alias("memory_id"), place.alias("place")).filter("place <= 12")
