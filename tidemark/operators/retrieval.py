"""Ranked lists: merging, fusion, interleaving, ordering, evidence expansion and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
EXACT_BOOST, STRUCTURED_BOOST, SCOPE_BOOST = 0.05, 0.01, 0.005
#: Memory types that an intent asks for; fixed values.
STRUCTURED_TYPES = {
    "decision_rationale": ("decision",),
    "debugging_history": ("episode",),
    "open_items": ("open_item",),
    "latest_state": ("session_synopsis", "workstream_synopsis", "project_synopsis", "decision", "open_item"),
    "chronology": ("decision", "episode"),
    "broad_synthesis": ("session_synopsis", "workstream_synopsis", "project_synopsis"),
}
CURRENTNESS = ("current_as_of_commit", "historical_unverified", "unknown_currentness", "superseded")


def lexical_merge(exact: DataFrame, full_text: DataFrame, limit: int) -> DataFrame:
    """(entity_id, channel, rank): exact hits first, then full-text ones not yet there, ranked anew."""
    both = exact.select("entity_id", "rank", F.lit("exact").alias("channel"), F.lit(0).alias("_p")).union(
        full_text.select("entity_id", "rank", F.lit("fts"), F.lit(1))
    )
    first = Window.partitionBy("entity_id").orderBy("_p", "rank")
    once = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    kept = once.orderBy("_p", "rank", "entity_id").limit(limit)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("_p", "rank", "entity_id"))).drop("_p", "_n")


def contribution(intent: str) -> Column:
    """What a candidate (channel, rank) adds to its entity's score."""
    part = 1.0 / (RRF_K + F.col("rank"))
    if intent in ("exact_error", "exact_identifier"):
        part += F.when(F.col("channel") == "exact", EXACT_BOOST).otherwise(0.0)
    if intent != "general":
        part += F.when(F.col("channel") == "structured", STRUCTURED_BOOST).otherwise(0.0)
    return part


def fuse(candidates: DataFrame, intent: str, explicit_scope: bool, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of (branch, entity_id, channel, rank, position): one contribution a branch."""
    first = Window.partitionBy("branch", "entity_id").orderBy("position")
    once = candidates.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    fused = once.groupBy("entity_id").agg(F.sum(contribution(intent)).alias("fused_score"), F.count(F.lit(1)).alias("branches"))
    fused = fused.withColumn("fused_score", F.col("fused_score") + (SCOPE_BOOST if explicit_scope else 0.0))
    return fused.orderBy(F.desc("fused_score"), "entity_id").limit(limit)


def interleave(branches: DataFrame, limit: int) -> DataFrame:
    """Round robin over (branch_no, rank, entity_id, channel): first place of each entity and channel."""
    first = Window.partitionBy("entity_id", "channel").orderBy("rank", "branch_no")
    once = branches.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    kept = once.orderBy("rank", "branch_no").limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("rank", "branch_no")))


def diversify(hits: DataFrame, limit: int) -> DataFrame:
    """hits (entity_id, position, evidence_ids, group_key): repeated evidence goes, then round robin over groups."""
    signature = F.array_join(F.array_sort("evidence_ids"), "\x00")
    keyed = hits.withColumn("_s", F.when(signature != "", signature).otherwise(F.concat(F.lit("\x01"), F.col("entity_id").cast("string"))))
    once = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy("position"))).filter("_n = 1")
    turns = once.withColumn("_turn", F.row_number().over(Window.partitionBy("group_key").orderBy("position"))).withColumn(
        "_first", F.min("position").over(Window.partitionBy("group_key"))
    )
    kept = turns.orderBy("_turn", "_first").limit(limit)
    return kept.withColumn("place", F.row_number().over(Window.orderBy("_turn", "_first"))).drop("_s", "_n", "_turn", "_first")


def chronology_order(intent: str) -> list[Column]:
    """Order of hits (currentness, observed_at, fused_score, entity_id) by intent; nulls last in chronology, else first."""
    if intent == "chronology":
        lead = [F.col("observed_at").asc_nulls_last()]
    elif intent in ("latest_state", "decision_rationale"):
        rank = F.array_position(F.array(*map(F.lit, CURRENTNESS)), F.col("currentness"))
        lead = [rank.asc(), F.col("observed_at").desc_nulls_first()]
    else:
        return [F.col("position").asc()]
    return [*lead, F.desc("fused_score"), F.col("entity_id").asc()]


def evidence_neighbours(events: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Events within an ordinal distance of an anchor of their session, once each (distance, not rows)."""
    near = events.alias("e").join(
        anchors.select("session_id", F.col("ordinal").alias("_at")).alias("a"),
        (F.col("e.session_id") == F.col("a.session_id")) & F.col("e.ordinal").between(F.col("_at") - before, F.col("_at") + after),
        "left_semi",
    )
    return near


def with_tool_partners(found: DataFrame, events: DataFrame) -> DataFrame:
    """found and the other halves of its tool pairs, by session and call id."""
    calls = found.filter("tool_call_id is not null").select("session_id", "tool_call_id").distinct()
    return found.unionByName(events.join(calls, ["session_id", "tool_call_id"], "left_semi").select(found.columns)).dropDuplicates(["event_id"])


def budget_prefix(items: DataFrame, group: str | None, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The longest prefix, in order, whose running cost is within the budget."""
    by = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(1))).orderBy(*order)
    spent = items.withColumn("spent", F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return spent.filter(F.col("spent") <= budget)


ANCHORS = 100


def expand_evidence(events: DataFrame, asked: DataFrame, chunks: DataFrame | None = None, before: int = 1, after: int = 1, anchors: int = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """What requests (request_id, evidence_id) of chunks or events are shown: their events, and a row a request.

    events (event_id, session_id, ordinal, tool_call_id, ...) and chunks (chunk_id, event_ids) are those that may be
    seen. A request's first `anchors` events, in their order, bring the events within an ordinal distance and
    the other halves of tool pairs. The second result is (request_id, unavailable, too_many): ids that
    nothing may be shown of, and whether anchors were left out.
    """
    wanted = asked.select("request_id", "evidence_id").distinct()
    found = wanted.join(events.select(F.col("event_id").alias("evidence_id"), "event_id", "session_id", "ordinal"), "evidence_id")
    if chunks is not None:
        members = chunks.select(F.col("chunk_id").alias("evidence_id"), F.explode("event_ids").alias("event_id"))
        of_chunks = wanted.join(members, "evidence_id").join(events.select("event_id", "session_id", "ordinal"), "event_id")
        found = found.unionByName(of_chunks)
    once = found.groupBy("request_id", "event_id").agg(F.first("session_id").alias("session_id"), F.first("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("session_id", "ordinal", "event_id"))
    numbered = once.withColumn("_n", place)
    kept = numbered.filter(F.col("_n") <= anchors)
    spans = kept.select("request_id", F.col("session_id").alias("_s"), (F.col("ordinal") - before).alias("_from"), (F.col("ordinal") + after).alias("_to"))
    near = events.join(spans, (F.col("session_id") == F.col("_s")) & F.col("ordinal").between(F.col("_from"), F.col("_to"))).drop("_s", "_from", "_to")
    if "tool_call_id" in events.columns:
        calls = near.filter("tool_call_id is not null").select("request_id", "session_id", "tool_call_id").distinct()
        near = near.unionByName(events.join(calls, ["session_id", "tool_call_id"]).select(near.columns))
    lost = wanted.join(found.select("request_id", "evidence_id").distinct(), ["request_id", "evidence_id"], "left_anti")
    summary = (
        wanted.select("request_id").distinct()
        .join(lost.groupBy("request_id").agg(F.sort_array(F.collect_list("evidence_id")).alias("unavailable")), "request_id", "left")
        .join(numbered.groupBy("request_id").agg((F.max("_n") > anchors).alias("too_many")), "request_id", "left")
        .select("request_id", F.coalesce("unavailable", F.array().cast("array<string>")).alias("unavailable"), F.coalesce("too_many", F.lit(False)).alias("too_many"))
    )
    return near.dropDuplicates(["request_id", "event_id"]), summary


def pack_evidence(shown: DataFrame, summary: DataFrame, most_items: int, most_tokens: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The longest beginning of each request's events (with tokens and bytes) within all three budgets, and what it reached.

    One pass in order of (session_id, ordinal, event_id) runs all three sums. The second result has a row a
    request: items, tokens, bytes, limits (those that its events go beyond, by name) and unavailable ids.
    """
    by = Window.partitionBy("request_id").orderBy("session_id", "ordinal", "event_id")
    along = by.rowsBetween(Window.unboundedPreceding, 0)
    placed = shown.withColumns({"place": F.row_number().over(by), "spent_tokens": F.sum("tokens").over(along), "spent_bytes": F.sum("bytes").over(along)})
    fits = (F.col("place") <= most_items) & (F.col("spent_tokens") <= most_tokens) & (F.col("spent_bytes") <= most_bytes)
    # Sums never fall, so what fits is a beginning.
    first = F.col("place") <= most_items
    reached = placed.groupBy("request_id").agg(
        F.count_if(fits).alias("items"), F.coalesce(F.sum(F.when(fits, F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(fits, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.bool_or(~first).alias("_items"), (F.sum(F.when(first, F.col("tokens"))) > most_tokens).alias("_tokens"), (F.sum(F.when(first, F.col("bytes"))) > most_bytes).alias("_bytes"),
    )
    told = summary.join(reached, "request_id", "left")
    limits = F.array_compact(F.array(F.when(F.col("_items") | F.col("too_many"), "items"), F.when(F.col("_tokens"), "tokens"), F.when(F.col("_bytes"), "bytes")))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return placed.filter(fits), told.select("request_id", none("items"), none("tokens"), none("bytes"), limits.alias("limits"), "unavailable")


def validate(candidates: DataFrame, content: DataFrame) -> DataFrame:
    """Fused candidates that content still holds with the same fingerprint, with their rows."""
    return candidates.join(content, ["entity_id", "fingerprint"])
