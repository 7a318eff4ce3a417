"""Embedding work: claims, leases, acknowledgements and records as conditional projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runnable(now: Column) -> Column:
    waiting = F.col("state").isin("pending", "retry") & (F.col("not_before").isNull() | (F.col("not_before") <= now))
    lapsed = (F.col("state") == "processing") & (F.col("lease_until") <= now)
    return F.coalesce(waiting | lapsed, F.lit(False))


def claim(jobs: DataFrame, now: Column, lease: Column, limit: int) -> DataFrame:
    """The oldest runnable jobs, leased."""
    chosen = jobs.filter(runnable(now)).orderBy("created_at", "job_id").limit(limit)
    return chosen.withColumns({"state": F.lit("processing"), "lease_until": lease, "attempts": F.col("attempts") + 1})


def requeue_expired(jobs: DataFrame, now: Column) -> DataFrame:
    lapsed = F.coalesce((F.col("state") == "processing") & (F.col("lease_until") <= now), F.lit(False))
    return jobs.withColumns(
        {"state": F.when(lapsed, "pending").otherwise(F.col("state")), "lease_until": F.when(~lapsed, F.col("lease_until"))}
    )


def acknowledge(jobs: DataFrame, desires: DataFrame) -> DataFrame:
    """Processing jobs, accepted where they are what the desires still ask for."""
    keys = ["entity_kind", "entity_id", "space_id"]
    met = jobs.filter("state = 'processing'").alias("j").join(desires.alias("d"), keys, "left")
    current = (F.col("j.fingerprint") == F.col("d.fingerprint")) & (F.col("j.operation") == F.col("d.operation"))
    return met.select(*keys, "job_id", F.col("j.fingerprint").alias("fingerprint"), F.coalesce(current, F.lit(False)).alias("accepted"))


def fresh_records(records: DataFrame, desires: DataFrame) -> DataFrame:
    """Records whose fingerprint is the one desired for upsert."""
    keys = ["entity_kind", "entity_id", "space_id", "fingerprint"]
    return records.join(desires.filter("operation = 'upsert'").select(*keys), keys, "left_semi")


def settle(jobs: DataFrame, failed: Column, most_attempts: int) -> DataFrame:
    """Failed processing jobs wait for another try until their attempts are used up."""
    gone = failed & (F.col("state") == "processing")
    return jobs.withColumn(
        "state", F.when(gone & (F.col("attempts") >= most_attempts), "failed").when(gone, "retry").otherwise(F.col("state"))
    )
