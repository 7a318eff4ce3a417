"""What a search may be narrowed by: types, times, paths inside the text, a session's branch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

#: Types and settled states of memories; fixed values.
MEMORY_TYPES = ("session_synopsis", "decision", "open_item")
TERMINAL_STATES = ("superseded", "resolved", "dismissed")


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATES)


def in_time(observed_at: Column, start: str | None, end: str | None) -> Column:
    """A row without a time is in no range; times are ISO text, so they compare as text."""
    found = F.lit(True)
    if start is not None:
        found = found & F.coalesce(observed_at >= start, F.lit(False))
    if end is not None:
        found = found & F.coalesce(observed_at <= end, F.lit(False))
    return found


def has_path(body: Column, paths: Sequence[str] | None) -> Column:
    """Whether the text holds any of the paths, letter case and compatibility forms apart."""
    if not paths:
        return F.lit(True)
    plain = F.lower(text.nfkc(body))
    found = F.lit(False)
    for path in paths:
        found = found | F.contains(plain, F.lower(F.trim(text.nfkc(F.lit(path)))))
    return F.coalesce(found, F.lit(False))


def narrowed(
    hits: DataFrame,
    sessions: DataFrame | None = None,
    types: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    paths: Sequence[str] | None = None,
    branch: str | None = None,
) -> DataFrame:
    """hits (type, observed_at, body, session_id) that pass; a hit without a type, as a chunk, passes only where none is asked for."""
    found = hits.filter(in_time(F.col("observed_at"), start, end) & has_path(F.col("body"), paths))
    if types:
        found = found.filter(F.coalesce(F.col("type").isin(*types), F.lit(False)))
    if branch is not None:
        if sessions is None:
            return found.limit(0)
        found = found.join(sessions.filter(F.col("branch") == branch).select("session_id"), "session_id", "left_semi")
    return found
