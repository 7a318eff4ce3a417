"""Evidence of memories and hits: unions in first-seen order, validity, embedding spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_ids(*lists: Column) -> Column:
    """Distinct ids of several lists in the order they are first seen; null lists are empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(c, empty) for c in lists)))


def survivors(candidates: DataFrame, content: DataFrame) -> DataFrame:
    """Candidates (entity_id, matches array of (channel, fingerprint, part), boost) with the score of what is still fresh.

    Matches whose fingerprint is no longer the entity's are dropped; entities without any are too.
    """
    met = candidates.join(content.select("entity_id", F.col("fingerprint").alias("_now")), "entity_id")
    fresh = met.withColumn("matches", F.filter("matches", lambda m: m["fingerprint"] == F.col("_now"))).filter(F.size("matches") > 0)
    score = F.aggregate(F.transform("matches", lambda m: m["part"]), F.lit(0.0), lambda s, x: s + x) + F.col("boost")
    return fresh.withColumn("fused_score", score).drop("_now")


def activate_space(spaces: DataFrame, space_id: str, now: str) -> DataFrame:
    """Spaces with one made active: the one that was is retired."""
    is_it, was = F.col("space_id") == space_id, F.col("status") == "active"
    return spaces.withColumns(
        {"status": F.when(is_it, "active").when(was, "retired").otherwise(F.col("status")), "retired_at": F.when(~is_it & was, now).otherwise(F.col("retired_at"))}
    )


def compatible(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of all columns that make two embedding spaces one."""
    found = F.lit(True)
    for c in columns:
        found &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return found


def valid_vector(vector: Column, size: int) -> Column:
    """A vector of the space's size with finite parts only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))
