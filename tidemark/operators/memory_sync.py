"""Incremental memories: only sessions whose events changed are derived again.

A session's mark is the number of its rows and a sum of their hashes, so it does not depend on their order and
is combined before the shuffle. Rows without a session belong to none and are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import memory


def session_marks(events: DataFrame, content: list[str], session: str = "session_id") -> DataFrame:
    """(session_id, n_rows, mark) of each session's rows."""
    # Columns with their nulls told apart: a hash of columns passes nulls over.
    row = F.xxhash64(*(c for name in content for c in (F.col(name), F.col(name).isNull())))
    return (
        events.filter(F.col(session).isNotNull())
        .groupBy(F.col(session).alias("session_id"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row.cast("decimal(20,0)")).alias("mark"))
    )


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, change): sessions whose marks are new, changed or gone."""
    marks = lambda df, name: df.select("session_id", F.struct("n_rows", "mark").alias(name))
    both = marks(before, "_before").join(marks(after, "_after"), "session_id", "full")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_after").isNull(), "gone").when(F.col("_before") != F.col("_after"), "changed")
    return both.select("session_id", change.alias("change")).filter("change is not null")


def apply(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories after the changes of `memory.diff`."""
    kept = memories.join(changes.select("memory_id"), "memory_id", "left_anti")
    return kept.unionByName(changes.filter("change <> 'delete'").select(*memories.columns))


def changes(events: DataFrame, sessions: DataFrame, memories: DataFrame, derive: Callable[[DataFrame], DataFrame], now: str, owned: list[str]) -> DataFrame:
    """What the touched sessions change: derive sees their events only, and only their memories are compared.

    Memories of extractors that are not in `owned`, as of one that failed, are never deleted.
    """
    own = sessions.select("session_id")
    desired = derive(events.join(own, "session_id", "left_semi"))
    return memory.diff(desired, memories.join(own, "session_id", "left_semi"), now, owned)
