"""The engine's verbs over its tables: scopes, overview, search, evidence, index upkeep, export."""

from __future__ import annotations

import base64
import functools
import hashlib
import hmac
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.functions import ids, normalize, redaction, text
from tidemark.operators import chunking, evidence, filters, forget, memory, retrieval, scope, search_index, semantic, sync, synopsis
from tidemark.operators.stored_index import StoredIndex
from tidemark.sources import workspace

#: Extractors of memories with their versions; a new one makes their memories new.
EXTRACTORS = {"decision": "decisions-2", "open_item": "open-items-1", "session_synopsis": "synopsis-1"}
#: Candidates of a channel, and intents that look at a session's latest chunks; fixed values.
CANDIDATES, RECENT = 50, 10
EXACT_INTENTS = ("exact_error", "exact_identifier")
RECENT_INTENTS = ("latest_state", "chronology", "debugging_history")
#: Bounds of a request: least, most and default; fixed values.
ITEMS, TOKENS, BYTES = (1, 20, 12), (128, 6000, 6000), 131_072
RESERVE = 512


def clamp(value: float | None, bounds: tuple[int, int, int]) -> int:
    """A requested number as a whole one within its bounds."""
    least, most, default = bounds
    if value is None or math.isnan(value):
        return default
    return max(least, min(most, math.trunc(value)))


@dataclass
class Tables:
    """What the engine works on; each a DataFrame."""

    events: DataFrame
    scopes: DataFrame
    tombstones: DataFrame
    aliases: DataFrame
    #: (session_id, branch) of what is known of sessions; filters by branch need it.
    sessions: DataFrame | None = None
    #: Embedding spaces with their status, and the stored vectors.
    spaces: DataFrame | None = None
    vectors: semantic.VectorTable | None = None
    chunks: DataFrame | None = None
    memories: DataFrame | None = None


@dataclass
class Packed:
    """Items that fit a budget, what was left out, and where to go on."""

    items: list[dict]
    truncated: bool
    cursor: str | None = None
    status: str = "ok"
    extra: dict = field(default_factory=dict)


def count_tokens(value: str) -> int:
    import regex

    return len(regex.findall(text.TOKEN, value))


def encode_cursor(offset: int, context: str, secret: bytes) -> str:
    body = json.dumps({"o": offset, "c": hashlib.sha256(context.encode()).hexdigest()}, separators=(",", ":")).encode()
    mac = hmac.new(secret, body, hashlib.sha256).digest()
    return ".".join(base64.urlsafe_b64encode(p).decode().rstrip("=") for p in (body, mac))


def decode_cursor(cursor: str, context: str, secret: bytes) -> int:
    """The offset of a cursor that this secret signed for this context; else ValueError."""
    try:
        body, mac = (base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in cursor.split("."))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not hmac.compare_digest(mac, hmac.new(secret, body, hashlib.sha256).digest()):
        raise ValueError("not a cursor of this engine")
    told = json.loads(body)
    if told["c"] != hashlib.sha256(context.encode()).hexdigest():
        raise ValueError("the cursor belongs to another request")
    return told["o"]


def pack(items: list[dict], most: int, tokens: int, snippet: str = "snippet") -> tuple[list[dict], bool]:
    """Items in order while they fit; a snippet is cut by halving to fit, an item that cannot fit is passed over."""
    out, spent_tokens, spent_bytes, cut = [], RESERVE // 4, RESERVE, False
    for item in items:
        if len(out) == most:
            return out, True

        def fits(size: int, item=item) -> dict | None:
            made = item | ({snippet: item[snippet][:size]} if snippet in item else {})
            said = json.dumps(made, ensure_ascii=False)
            ok = spent_tokens + count_tokens(said) <= tokens and spent_bytes + len(said.encode()) <= BYTES
            return made if ok else None

        low, high = 0, len(item.get(snippet, ""))
        best = fits(high)
        if best is None:
            cut = True
            while low < high:
                middle = (low + high + 1) // 2
                if fits(middle):
                    low = middle
                else:
                    high = middle - 1
            best = fits(low) if low or snippet not in item else None
            if best is None:
                continue
        said = json.dumps(best, ensure_ascii=False)
        spent_tokens += count_tokens(said)
        spent_bytes += len(said.encode())
        out.append(best)
    return out, cut


class Engine:
    """Four read verbs and the upkeep verbs. Plans are lazy; a request collects at most twice its items.

    Chunks, memories and the index are written to the shared folder, so that a search reads them and derives nothing.
    """

    def __init__(self, spark: SparkSession, tables: Tables, secret: bytes = b"local", root: str | None = None, provider: semantic.Provider | None = None) -> None:
        self.spark, self.t, self.secret, self.provider = spark, tables, secret, provider
        self.root = root or workspace.new_folder(spark, "engine")
        self.stored = StoredIndex(spark, f"{self.root}/index")
        self.written = 0

    def list_scopes(self, query: str | None = None, limit: int = 20) -> DataFrame:
        return scope.ambiguous(scope.candidates(self.t.scopes, self.t.aliases, query, min(20, limit)))

    def _store(self, df: DataFrame, label: str) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{label}/{self.written}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def index(self, target: int = 600, most: int = 900) -> None:
        """Chunks, memories and the search index from all events."""
        self.t.chunks = self._store(chunking.chunks(self.t.events, "session_id", ["ordinal"], target, most), "chunks")
        self.t.memories = self._store(self._derive(self.t.chunks), "memories")
        self.stored.update(self._content())

    def reindex(self, sessions: DataFrame, target: int = 600, most: int = 900) -> DataFrame:
        """(chunk_id, change) after rebuilding the given sessions: only their chunks, memories and postings are derived anew."""
        own = scope.small(sessions.select("session_id"))
        built = self._store(chunking.chunks(self.t.events.join(own, "session_id", "left_semi"), "session_id", ["ordinal"], target, most), "rebuilt")
        change = self._store(sync.diff(self.t.chunks.join(own, "session_id", "left_semi"), built, "chunk_id", "fingerprint"), "changes")
        derived = self._derive(built)
        self.t.chunks = self._store(self.t.chunks.join(own, "session_id", "left_anti").unionByName(built), "chunks")
        self.t.memories = self._store(self.t.memories.join(own, "session_id", "left_anti").unionByName(derived), "memories")
        self.stored.update(self._content().join(own, "session_id", "left_semi"), sessions.select("session_id"))
        return change

    @staticmethod
    def _derive(chunks: DataFrame) -> DataFrame:
        """(memory_id, session_id, type, title, body, status, observed_at, evidence_ids, extractor) of chunks."""
        told = chunks.select("session_id", "chunk_id", F.col("observed_from").alias("observed_at"), "display_text")
        found = memory.decisions(told)
        decided = found.join(memory.timeline(found).drop("session_id"), "memory_id").select(
            "memory_id", "session_id", F.lit("decision").alias("type"), "title", "body", "status", "observed_at", F.array("chunk_id").alias("evidence_ids")
        )
        items = memory.open_items(told).select(
            ids.stable_id("memory", F.lit("open_item"), F.col("session_id").cast("string"), F.col("chunk_id"), F.lower("item")).alias("memory_id"),
            "session_id", F.lit("open_item").alias("type"), F.concat(F.lit("Open item: "), text.bounded(F.col("item"), 120)).alias("title"), F.col("item").alias("body"),
            F.lit("candidate").alias("status"), F.lit(None).cast("string").alias("observed_at"), F.array("chunk_id").alias("evidence_ids"),
        )
        told = synopsis.synopses(chunks).select(
            "memory_id", "session_id", F.lit("session_synopsis").alias("type"), F.lit("Session synopsis").alias("title"), "body",
            F.lit("active").alias("status"), F.col("observed_to").alias("observed_at"), "evidence_ids",
        )
        version = F.create_map(*(F.lit(x) for kv in EXTRACTORS.items() for x in kv))[F.col("type")]
        return decided.unionByName(items).unionByName(told).withColumn("extractor", version)

    def embed(self, space_id: str) -> None:
        """Vectors of all content in a space, by the engine's provider; the space must be that of the provider."""
        sessions = self.t.scopes.filter("scope_kind = 'session'").select(F.col("scope_id").alias("session_key"), "project_id", "workstream_id")
        placed = self._content().withColumn("session_key", F.col("session_id").cast("string")).join(sessions, "session_key").drop("session_id").withColumnRenamed("session_key", "session_id")
        self.t.vectors = semantic.VectorTable(self.spark, f"{self.root}/vectors/{self.stored.generation()}")
        self.t.vectors.write(semantic.embedded(placed, self.provider, space_id), int(self.provider.manifest()["dimensions"]))

    def _content(self) -> DataFrame:
        """What a search may find: chunks, and memories with their types."""
        at = F.coalesce("observed_to", "observed_from")
        dated = lambda c: F.when(c.isNull(), "unknown_currentness").otherwise("historical_unverified")
        chunks = self.t.chunks.select(
            F.col("chunk_id").alias("entity_id"), "session_id", F.lit("chunk").alias("type"), F.lit("").alias("title"), F.col("display_text").alias("body"),
            at.alias("observed_at"), "fingerprint", F.col("event_ids").alias("evidence_ids"), dated(at).alias("currentness"), "sequence",
        )
        current = F.when(F.col("status") == "superseded", "superseded").otherwise("historical_unverified")
        memories = self.t.memories.select(
            F.col("memory_id").alias("entity_id"), "session_id", "type", "title", "body", "observed_at",
            ids.fingerprint(F.col("title"), F.col("body"), F.col("extractor")).alias("fingerprint"), "evidence_ids", current.alias("currentness"), F.lit(None).cast("long").alias("sequence"),
        )
        return chunks.unionByName(memories)

    def _placed(self, rows: DataFrame, boundary: Mapping[str, str | None]) -> DataFrame:
        """Rows of sessions inside a boundary that no tombstone hides; their own session id is in _session."""
        sessions = self.t.scopes.filter("scope_kind = 'session'").select(F.col("scope_id").alias("session_key"), "project_id", "workstream_id")
        placed = rows.withColumn("session_key", F.col("session_id").cast("string")).join(sessions, "session_key", "left")
        marked = placed.withColumnRenamed("session_id", "_session").withColumnRenamed("session_key", "session_id")
        return scope.visible(marked.filter(scope.within(boundary)), self.t.tombstones)

    def _visible_chunks(self, boundary: Mapping[str, str | None]) -> DataFrame:
        return self._placed(self.t.chunks, boundary)

    def search(
        self,
        asked: str,
        boundary: Mapping[str, str | None],
        limit: float | None = None,
        tokens: float | None = None,
        cursor: str | None = None,
        types: Sequence[str] | None = None,
        start: str | None = None,
        end: str | None = None,
        paths: Sequence[str] | None = None,
        branch: str | None = None,
    ) -> Packed:
        """What of a scope meets a query: exact, full-text, structured and recent candidates, narrowed, fused, checked and packed.

        A hit counts where its entity is still what it was when it was indexed. Order follows the intent, and
        hits are spread over sessions. The cursor goes on with this request on this state of the index.
        """
        try:
            query = normalize.plain_query(asked)
            search_index.query_phrases(query)
        except ValueError as e:
            raise EngineError("LIMIT_EXCEEDED", str(e)) from e
        if types and not set(types) <= set(filters.MEMORY_TYPES):
            raise EngineError("NOT_FOUND", "no such type of memory")
        generation = self.stored.generation()
        if generation < 0 or self.t.chunks is None:
            return Packed([], False, status="no_source")
        items, budget = clamp(limit, ITEMS), clamp(tokens, TOKENS)
        narrow = {"types": sorted(types or ()), "start": start, "end": end, "paths": sorted(paths or ()), "branch": branch}
        context = json.dumps([query, dict(boundary), narrow, generation], sort_keys=True)
        offset = decode_cursor(cursor, context, self.secret) if cursor else 0
        if self.t.tombstones.filter(scope.within({"project_id": boundary["project_id"]}) & F.col("workstream_id").isNull() & F.col("session_id").isNull()).limit(1).count():
            return Packed([], False, status="excluded")
        intent = self.spark.range(1).select(text.intent(F.lit(query)).alias("i")).first()["i"]
        seen = self._placed(self._content(), boundary)
        seen = filters.narrowed(seen.withColumn("_shown", F.concat_ws("\n", "title", "body")).withColumnsRenamed({"body": "_body", "_shown": "body"}), self.t.sessions, types, start, end, paths, branch)
        seen = seen.withColumnsRenamed({"body": "_shown", "_body": "body"})
        lexical = self._lexical(query, intent, seen, boundary, types, paths, generation)
        merged = retrieval.interleave(lexical, CANDIDATES).select("entity_id", "channel", "rank", "fingerprint", F.col("place").alias("position"))
        near = semantic.Found("not_applicable")
        if intent not in EXACT_INTENTS:
            near = semantic.retrieve(query, self.provider, self.t.spaces, self.t.vectors, boundary, CANDIDATES, types, start, end, paths, branch)
        merged = merged.withColumn("branch", F.lit("lexical"))
        if near.candidates is not None:
            ranked = near.candidates.select("entity_id", F.lit("semantic").alias("channel"), "rank", "fingerprint", F.col("rank").alias("position"), F.lit("semantic").alias("branch"))
            merged = merged.unionByName(ranked)
        fused = self._fused(merged, seen, intent, boundary)
        hits = fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("fused_score"), "entity_id")))
        ordered = hits.withColumn("position", F.row_number().over(Window.orderBy(*retrieval.chronology_order(intent))))
        rows = retrieval.diversify(ordered.withColumn("group_key", F.col("session_id")), 2 * items + offset).filter(F.col("place") > offset).orderBy("place").collect()
        found = [{"id": r["entity_id"], "type": r["type"], "title": r["title"], "session": r["session_id"], "score": round(r["fused_score"], 9), "evidence": list(r["evidence_ids"]), "snippet": r["body"]} for r in rows]
        packed, cut = pack(found, items, budget)
        more = cut or len(found) > len(packed)
        status = "partial" if more else "ok" if packed else "empty"
        return Packed(packed, more, encode_cursor(offset + len(packed), context, self.secret) if more and packed else None, status, {"intent": intent, "generation": generation, "semantic": near.state})

    def _lexical(
        self, query: str, intent: str, seen: DataFrame, boundary: Mapping[str, str | None], types: Sequence[str] | None, paths: Sequence[str] | None, generation: int
    ) -> DataFrame:
        """(branch_no, entity_id, channel, rank, fingerprint) of the candidates: ranks are those inside what may be seen."""
        among = seen.select("entity_id")
        if paths:  # the index knows which entities hold a path
            wanted = [F.lower(F.trim(text.nfkc(F.lit(p)))) for p in paths]
            among = among.join(self.stored.exact_terms(["path"], generation).filter(F.col("normalized_term").isin(*wanted)).select("entity_id"), "entity_id", "left_semi")
        full = search_index.top(self.stored.bm25(query, generation).join(among, "entity_id", "left_semi").select("entity_id", "bm25"), [F.desc("bm25"), F.col("entity_id").asc()], CANDIDATES)
        terms = self.stored.exact_terms(generation=generation).join(among, "entity_id", "left_semi")
        exact = search_index.top(search_index.exact_search(terms, query), [F.col("score").asc(), F.col("entity_id").asc()], CANDIDATES)
        indexed = retrieval.lexical_merge(exact, full, CANDIDATES).join(self.stored.marks(generation), "entity_id")
        branches = [indexed.select(F.lit(0).alias("branch_no"), "entity_id", "channel", "rank", "fingerprint")]
        wanted_types = types or retrieval.STRUCTURED_TYPES.get(intent, ())
        if wanted_types:
            of_type = search_index.top(seen.filter(F.col("type").isin(*wanted_types)), [F.desc_nulls_last("observed_at"), F.col("entity_id").asc()], CANDIDATES)
            branches.append(of_type.select(F.lit(1).alias("branch_no"), "entity_id", F.lit("structured").alias("channel"), "rank", "fingerprint"))
        if boundary.get("session_id") is not None and intent in RECENT_INTENTS:
            latest = search_index.top(seen.filter("type = 'chunk'"), [F.desc("sequence"), F.col("entity_id").asc()], RECENT)
            branches.append(latest.select(F.lit(2).alias("branch_no"), "entity_id", F.lit("recent").alias("channel"), "rank", "fingerprint"))
        return functools.reduce(DataFrame.unionByName, branches)

    @staticmethod
    def _fused(merged: DataFrame, seen: DataFrame, intent: str, boundary: Mapping[str, str | None]) -> DataFrame:
        """seen rows with the score of their candidate, if that was of what the row still is."""
        first = Window.partitionBy("branch", "entity_id").orderBy("position")
        once = merged.withColumn("_n", F.row_number().over(first)).filter("_n = 1")  # one contribution a branch
        best = once.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("channel", "fingerprint", retrieval.contribution(intent).alias("part")))).alias("matches"))
        boost = F.lit(retrieval.SCOPE_BOOST if boundary.get("session_id") is not None else 0.0)
        return evidence.survivors(best.select("entity_id", "matches", boost.alias("boost")), seen.select("entity_id", "fingerprint")).select(
            "entity_id", "fused_score"
        ).join(seen, "entity_id")

    def overview(self, boundary: Mapping[str, str | None], limit: float | None = None) -> DataFrame:
        """The scope's memories: open ones before settled ones, latest first."""
        sessions = self._visible_chunks(boundary).select("_session").distinct()
        rank = F.when(F.col("type") == "session_synopsis", 0).when(F.col("type") == "decision", 1).otherwise(2)
        settled = filters.is_terminal(F.col("status")).cast("int")
        found = self.t.memories.join(sessions, F.col("session_id") == F.col("_session"), "left_semi")
        return found.orderBy(rank, settled, F.desc_nulls_last("observed_at"), "memory_id").limit(clamp(limit, ITEMS))

    def get_evidence(self, chunk_ids: list[str], boundary: Mapping[str, str | None], before: int = 1, after: int = 1) -> DataFrame:
        """The events of up to five chunks with their neighbours and whole tool pairs."""
        if not 1 <= len(chunk_ids) <= 5:
            raise ValueError("from one to five ids")
        members = self._visible_chunks(boundary).filter(F.col("chunk_id").isin(chunk_ids)).select(F.explode("event_ids").alias("event_id")).limit(100)
        anchors = self.t.events.join(scope.small(members), "event_id", "left_semi")
        near = retrieval.evidence_neighbours(self.t.events, anchors, min(20, max(0, before)), min(20, max(0, after))).select(self.t.events.columns)
        whole = retrieval.with_tool_partners(near, self.t.events) if "tool_call_id" in near.columns else near
        return whole.orderBy("session_id", "ordinal", "event_id").limit(1000)

    def pack_evidence(self, asked: Sequence[str], boundary: Mapping[str, str | None], before: int = 1, after: int = 1, limit: float | None = None, tokens: float | None = None) -> tuple[DataFrame, dict]:
        """The events behind up to five chunk or event ids, redacted, within the budget of a response; and what was spent, reached and not found."""
        if not 1 <= len(asked) <= 5:
            raise EngineError("LIMIT_EXCEEDED", "from one to five ids")
        near, far = min(20, max(0, before)), min(20, max(0, after))
        requests = self.spark.createDataFrame([(0, i) for i in asked], "request_id int, evidence_id string")
        placed = self._placed(self.t.events, boundary).drop("session_id", "project_id", "workstream_id").withColumnRenamed("_session", "session_id")
        shown, summary = retrieval.expand_evidence(placed, requests, self._visible_chunks(boundary).select("chunk_id", "event_ids"), near, far)
        clean = redaction.redact_column(shown, "text", "_clean").withColumn("text", redaction.redact_paths(F.coalesce("_clean.text", F.lit("")))).drop("_clean")
        sized = clean.withColumns({"tokens": text.token_count(F.col("text")), "bytes": F.octet_length("text")})
        events, spent = retrieval.pack_evidence(sized, summary, clamp(limit, ITEMS), clamp(tokens, TOKENS), BYTES)
        return events.orderBy("place"), spent.drop("request_id").first().asDict()

    def forget(self, boundary: Mapping[str, str | None], reason: str, now: str | None = None, purge: bool = True) -> str:
        """not_found, pending or complete: a tombstone first, so nothing of the scope is seen again; then its rows go.

        The rows, postings and vectors of its sessions go with what is linked to them; the tombstone stays and says so.
        """
        known = self.t.scopes.select("scope_kind", "scope_id", "project_id", "workstream_id")
        sessions = known.filter("scope_kind = 'session'").select("project_id", "workstream_id", F.col("scope_id").alias("session_id"))
        kind = "session" if boundary.get("session_id") else "workstream" if boundary.get("workstream_id") else "project"
        if not known.filter((F.col("scope_kind") == kind) & (F.col("scope_id") == boundary[f"{kind}_id"])).limit(1).count():
            return "not_found"
        marks = self.t.tombstones
        same = F.lit(True)
        for part in scope.PARTS:
            same &= F.col(part).eqNullSafe(F.lit(boundary.get(part)))
        if "status" in marks.columns and marks.filter(same & (F.col("status") == forget.DELETED)).limit(1).count():
            return "complete"
        self._mark(boundary, reason, forget.PENDING, now, same)
        if not purge or self.t.chunks is None:
            return "pending"
        gone = self._store(forget.sessions_within(sessions, boundary), "gone")
        left = forget.cascade(gone, self.t.events, self.t.chunks, self.t.memories)
        touched = self._store(self.t.chunks.join(left.gone_chunks, "chunk_id", "left_semi").select(F.col("session_id").cast("string").alias("session_id")).distinct().unionByName(gone).distinct(), "touched")
        self.t.events = self._store(left.events, "events")
        self.t.chunks, self.t.memories = self._store(left.chunks, "chunks"), self._store(left.memories, "memories")
        self.stored.update(self._content().join(touched, "session_id", "left_semi"), touched)
        if self.t.vectors is not None:
            self.t.vectors = self.t.vectors.without(gone, f"{self.root}/vectors/{self.written}-kept")
        self._mark(boundary, reason, forget.DELETED, now, same)
        return "complete"

    def _mark(self, boundary: Mapping[str, str | None], reason: str, status: str, now: str | None, same: Column) -> None:
        """The scope's tombstone in a new status; when it was first set is kept."""
        at = F.coalesce(F.lit(now), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        marks = self.t.tombstones
        for c in ("status", "excluded_at", "updated_at"):
            if c not in marks.columns:
                marks = marks.withColumn(c, F.lit(None).cast("string"))
        row = self.spark.createDataFrame([(boundary["project_id"], boundary.get("workstream_id"), boundary.get("session_id"), reason, status)], "project_id string, workstream_id string, session_id string, reason string, status string")
        first = marks.filter(same).agg(F.min("excluded_at").alias("_first"))
        made = row.crossJoin(first).select("*", F.coalesce("_first", at).alias("excluded_at"), at.alias("updated_at")).drop("_first")  # one row each
        self.t.tombstones = self._store(marks.filter(~same).select(made.columns).unionByName(made), "tombstones")

    def export(self, boundary: Mapping[str, str | None], path: str) -> None:
        self.overview(boundary, ITEMS[1]).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
