"""Keeping tables in step: dedupe with collision checks, reconciliation and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_events(events: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, copies, collision): equal ids must carry equal content."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), (F.min(digest) != F.max(digest)).alias("collision"))


def append_new(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not there yet: writing a batch twice adds nothing."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, deleted, changed or unchanged."""
    both = before.select(key, F.col(content).alias("_old"), F.lit(True).alias("_was")).join(
        after.select(key, F.col(content).alias("_new"), F.lit(True).alias("_is")), key, "full"
    )
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return both.select(key, change.alias("change"))


def reconcile_sources(persisted: DataFrame, discovered: DataFrame) -> DataFrame:
    """(path, change) of sources (path, kind, device, inode, size, modified_at): a lost path and a new one of the same file are a move."""
    full = persisted.alias("p").join(discovered.alias("d"), F.col("p.path") == F.col("d.path"), "full")
    same_file = (F.col("p.device") == F.col("d.device")) & (F.col("p.inode") == F.col("d.inode"))
    change = (
        F.when(F.col("p.path").isNull(), "new")
        .when(F.col("d.path").isNull(), "missing")
        .when(~same_file, "rotated")
        .when(F.col("d.size") < F.col("p.size"), "truncated")
        .when(F.col("d.size") > F.col("p.size"), "appended")
        .when(F.col("d.modified_at") != F.col("p.modified_at"), "touched")
        .otherwise("unchanged")
    )
    state = full.select(
        F.coalesce("p.path", "d.path").alias("path"), F.coalesce("p.kind", "d.kind").alias("kind"), F.coalesce("d.device", "p.device").alias("device"),
        F.coalesce("d.inode", "p.inode").alias("inode"), change.alias("change"),
    )
    order = Window.partitionBy("kind", "device", "inode", "change").orderBy("path")
    numbered = state.withColumn("_n", F.row_number().over(order))
    file = ["kind", "device", "inode", "_n"]
    lost = numbered.filter("change = 'missing'").select(*file, F.col("path").alias("moved_from"))
    found = numbered.filter("change = 'new'").select(*file, F.col("path").alias("_moved_to"))
    moves = found.join(lost, file).select("_moved_to", "moved_from")
    settled = state.join(moves, F.col("path") == F.col("_moved_to"), "left").join(moves.select(F.col("moved_from").alias("_gone")), F.col("path") == F.col("_gone"), "left_anti")
    return settled.select("path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), "moved_from")


def mirror_dedupe(events: DataFrame, keys: list[str], second: Column, distance: int = 8) -> DataFrame:
    """Drops the later of two events of one key and second, of other variants, within an ordinal distance."""
    by = Window.partitionBy(*keys, second).orderBy("ordinal", "event_id")
    earlier = F.lag(F.struct("ordinal", "variant")).over(by)
    mirrored = earlier.isNotNull() & (earlier["variant"] != F.col("variant")) & (F.col("ordinal") - earlier["ordinal"] <= distance)
    return events.withColumn("_mirrored", F.coalesce(mirrored, F.lit(False))).filter(~F.col("_mirrored")).drop("_mirrored")


def carry_forward(records: DataFrame, source: str, order: str, session: str, fallback: Column) -> DataFrame:
    """Each record with the session named last before it in its source, else the fallback."""
    by = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("carried_session", F.coalesce(F.last(session, ignorenulls=True).over(by), fallback))
