"""The registry of sources: what was seen of each file, what changed, and how far it has been read.

Registry columns: path, kind, device, inode, size, modified_at, committed_offset, first_seen_at, last_seen_at.
A sighting has the first six. Sightings of one path in one run count as the latest modified one (then the
largest). A sighting of invalid shape is a fault; the source it names keeps its row and is not missing.
A null device or inode leaves files apart by size alone. Empty tables are fine on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sync

SEEN = ["path", "kind", "device", "inode", "size", "modified_at"]
RUN = ["committed_offset", "first_seen_at", "last_seen_at"]


def fault() -> Column:
    """Why a sighting can't be registered, or null."""
    modified = F.col("modified_at").cast("double")
    return (
        F.when(F.col("path").isNull() | (F.col("path") == "") | F.contains("path", F.lit("\0")), "invalid_path")
        .when(F.col("size").isNull() | (F.col("size") < 0), "invalid_size")
        .when(modified.isNull() | F.isnan(modified) | (modified < 0) | (modified == float("inf")), "invalid_time")
    )


def fold(registry: DataFrame, sightings: DataFrame, now: Column) -> DataFrame:
    """The registry after a run that saw these files, with change and moved_from.

    Appended, touched, unchanged and moved files keep their place; rotated, truncated and new ones start at 0.
    """
    judged = sightings.select(*SEEN, fault().alias("_fault"))
    faulty = judged.filter("_fault is not null and path is not null").select("path").distinct()
    latest = F.max(F.struct("modified_at", "size", "kind", "device", "inode")).alias("_s")
    seen = judged.filter("_fault is null").join(faulty, "path", "left_anti").groupBy("path").agg(latest).select("path", "_s.*").select(*SEEN)
    known = registry.join(faulty, "path", "left_anti")

    changes = sync.reconcile_sources(known.select(*SEEN), seen)
    found = seen.select("path", F.struct(*SEEN).alias("_new"))
    held = known.select(F.col("path").alias("_held"), F.struct(*SEEN, *RUN).alias("_old"))
    both = changes.join(found, "path", "left").join(held, F.coalesce("moved_from", "path") == F.col("_held"), "left")

    anew = F.col("change").isin("new", "rotated")
    is_missing = F.col("change") == "missing"
    start = F.lit(0).cast(registry.schema["committed_offset"].dataType)
    folded = both.select(
        *(F.when(is_missing, F.col("_old")[c]).otherwise(F.col("_new")[c]).alias(c) for c in SEEN),
        F.when(anew | (F.col("change") == "truncated"), start).otherwise(F.col("_old.committed_offset")).alias("committed_offset"),
        F.when(anew, now).otherwise(F.col("_old.first_seen_at")).alias("first_seen_at"),
        F.when(is_missing, F.col("_old.last_seen_at")).otherwise(now).alias("last_seen_at"),
        "change", "moved_from",
    )
    unread = registry.join(faulty, "path", "left_semi").select(*SEEN, *RUN, F.lit("faulty").alias("change"), F.lit(None).cast("string").alias("moved_from"))
    return folded.unionByName(unread)


def run_totals(folded: DataFrame) -> DataFrame:
    """Sources of each kind and change, and the bytes that are left to read of them."""
    left = F.when(~F.col("change").isin("missing", "faulty"), F.greatest(F.col("size") - F.col("committed_offset"), F.lit(0))).otherwise(0)
    return folded.groupBy("kind", "change").agg(F.count(F.lit(1)).alias("sources"), F.sum(left).cast("long").alias("bytes_to_read"))


def advance(cursors: DataFrame, proposals: DataFrame, allow_backward: bool = False) -> DataFrame:
    """(source_id, fingerprint, committed_offset, line_hash, written_at, outcome): cursors after these writes.

    A source's last proposal counts (ties: the furthest). It is refused where it goes back in the same file,
    unless that is allowed; a file of another fingerprint may begin anywhere.
    """
    rest = ["written_at", "committed_offset", "fingerprint", "line_hash"]
    last = proposals.groupBy("source_id").agg(F.max(F.struct(*rest)).alias("_p"))
    both = cursors.select("source_id", F.struct(*rest).alias("_c")).join(last, "source_id", "full")
    back = (F.col("_c.fingerprint") == F.col("_p.fingerprint")) & (F.col("_p.committed_offset") < F.col("_c.committed_offset"))
    refused = F.coalesce(back, F.lit(False)) & F.lit(not allow_backward)
    outcome = F.when(F.col("_p").isNull(), "kept").when(refused, "refused").otherwise("written")
    return both.withColumn("outcome", outcome).select(
        "source_id", *(F.when(F.col("outcome") == "written", F.col("_p")[c]).otherwise(F.col("_c")[c]).alias(c) for c in ("fingerprint", "committed_offset", "line_hash", "written_at")), "outcome"
    )
