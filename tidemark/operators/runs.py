"""Ingestion runs: which sources come first, how far they are, when to try again, how a run ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_MS = 1_000
MOST_MS = 300_000
SOURCES_A_RUN = 64


def backoff_ms(attempts: Column, base: int = BASE_MS, most: int = MOST_MS) -> Column:
    """Delay after so many failures: doubled each time, up to a limit."""
    doublings = F.least(attempts - 1, F.lit(20)).cast("int")
    return F.least(F.lit(most).cast("long"), F.lit(base).cast("long") * F.pow(F.lit(2), doublings).cast("long"))


def deferred(retry_at_ms: Column, now_ms: Column) -> Column:
    return F.coalesce(retry_at_ms > now_ms, F.lit(False))


def prioritized(sources: DataFrame, most: int = SOURCES_A_RUN) -> DataFrame:
    """The sources of a run: the last modified first, ties by path."""
    return sources.orderBy(F.desc("modified_at_ms"), "normalized_path").limit(most)


def health(live: DataFrame, persisted: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source_id, size_bytes, indexed_bytes, lag_bytes, status) of live and of known sources."""
    known = persisted.select("source_id", F.col("size").alias("_size"))
    both = live.select("source_id", "size", F.lit(True).alias("_live")).join(known, "source_id", "full")
    at = both.join(cursors.select("source_id", "committed"), "source_id", "left")
    size, done = F.coalesce("size", "_size"), F.coalesce("committed", F.lit(0))
    status = (
        F.when(F.col("_live").isNull(), "missing").when(F.col("committed").isNull(), "not_indexed").when(F.col("committed") < size, "stale").otherwise("current")
    )
    return at.select("source_id", size.alias("size_bytes"), done.alias("indexed_bytes"), F.greatest(F.lit(0), size - done).alias("lag_bytes"), status.alias("status"))


def run_status(discovered: Column, attempted: Column, failed: Column, lagging: Column) -> Column:
    """How a run over sources ended."""
    return (
        F.when(discovered == 0, "no_source").when(failed == attempted, "failed").when((failed > 0) | (lagging > 0), "partial").otherwise("ok")
    )


def index_status(ingestion: Column, processed: Column, any_partial: Column) -> Column:
    """How ingestion and the processing after it ended together."""
    return (
        F.when(ingestion == "failed", "failed")
        .when((ingestion == "no_source") & (processed == 0), "no_source")
        .when((ingestion == "partial") | any_partial, "partial")
        .otherwise("ok")
    )


def enqueue(jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs by job_id, desires by entity and space) after new jobs: a later row takes an earlier one's place, created_at stays."""
    from tidemark.operators.sessions import upsert

    all_jobs = upsert(jobs, new, ["job_id"], "updated_at", kept=("created_at",))
    desires = new.select("entity_kind", "entity_id", "space_id", "desired_fingerprint", "operation", "updated_at")
    latest = upsert(desires.limit(0), desires, ["entity_kind", "entity_id", "space_id"], "updated_at")
    return all_jobs, latest
