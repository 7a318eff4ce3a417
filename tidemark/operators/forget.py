"""Forgetting a scope: what its sessions' rows are linked to goes with them, table by table.

Links are followed once each way: sessions to events, events to chunks, chunks to memories, events to objects.
A chunk goes with any of its events; a memory loses the evidence that goes, and goes itself where none
is left; an object goes when nothing that stays refers to it. All of it is joins on the links' keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scope

#: States of a forgotten scope; fixed values.
PENDING, DELETED = "deletion_pending", "deleted"


@dataclass
class Left:
    """What stays, and the ids of what goes."""

    events: DataFrame
    chunks: DataFrame
    memories: DataFrame
    objects: DataFrame | None
    gone_sessions: DataFrame
    gone_chunks: DataFrame
    gone_objects: DataFrame | None


def sessions_within(sessions: DataFrame, boundary: Mapping[str, str | None]) -> DataFrame:
    """(session_id) of sessions (project_id, workstream_id, session_id) inside a boundary."""
    return sessions.filter(scope.within(boundary)).select("session_id").distinct()


def cascade(gone: DataFrame, events: DataFrame, chunks: DataFrame, memories: DataFrame, links: DataFrame | None = None) -> Left:
    """The tables without what belongs to the sessions of gone (session_id).

    events (event_id, session_id), chunks (chunk_id, session_id, event_ids), memories (memory_id, session_id, evidence_ids),
    links (object_id, event_id) of objects.
    """
    dead_events = events.join(gone, "session_id", "left_semi").select("event_id")
    members = chunks.select("chunk_id", F.explode("event_ids").alias("event_id"))
    of_events = members.join(dead_events, "event_id", "left_semi").select("chunk_id")
    dead_chunks = of_events.unionByName(chunks.join(gone, "session_id", "left_semi").select("chunk_id")).distinct()
    own = memories.join(gone, "session_id", "left_anti")
    evidence = own.select("memory_id", F.posexplode("evidence_ids").alias("_no", "chunk_id"))
    lost = evidence.join(dead_chunks, "chunk_id", "left_semi").groupBy("memory_id").agg(F.collect_set("chunk_id").alias("_lost"))
    # A memory's evidence is a short list.
    trimmed = own.join(lost, "memory_id", "left").withColumn("evidence_ids", F.when(F.col("_lost").isNull(), F.col("evidence_ids")).otherwise(F.array_except("evidence_ids", "_lost")))
    kept_memories = trimmed.filter(F.col("_lost").isNull() | (F.size("evidence_ids") > 0)).select(memories.columns)
    objects = dead_objects = None
    if links is not None:
        objects = links.join(dead_events, "event_id", "left_anti")
        dead_objects = links.select("object_id").distinct().join(objects.select("object_id").distinct(), "object_id", "left_anti")
    return Left(
        events.join(gone, "session_id", "left_anti"), chunks.join(dead_chunks, "chunk_id", "left_anti"), kept_memories, objects, gone, dead_chunks, dead_objects
    )
