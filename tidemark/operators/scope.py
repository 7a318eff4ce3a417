"""Scopes: containment, visibility behind tombstones, candidates and their scores."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("project_id", "workstream_id", "session_id")
#: Tables up to this many rows are broadcast; larger ones take Spark's own choice of join.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast df if a check of its size allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def within(boundary: Mapping[str, str | None]) -> Column:
    """Rows inside a boundary: its project, and its workstream and session where it names them."""
    found = F.col("project_id") == boundary["project_id"]
    for part in PARTS[1:]:
        if boundary.get(part) is not None:
            found &= F.col(part) == boundary[part]
    return F.coalesce(found, F.lit(False))


def same_scope(left: str, right: str) -> Column:
    found = F.lit(True)
    for part in PARTS:
        found &= F.col(f"{left}.{part}").eqNullSafe(F.col(f"{right}.{part}"))
    return found


def _by_level(tombstones: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """Tombstones by which parts they set: those parts, and the tombstones that set them alone. Unset parts are wildcards."""
    levels = []
    for workstream in (False, True):
        for session in (False, True):
            named = [c for c, there in zip(PARTS, (True, workstream, session)) if there]
            of = tombstones.filter(F.col("workstream_id").isNotNull() == workstream).filter(F.col("session_id").isNotNull() == session)
            levels.append((named, of))
    return levels


def _meets(named: list[str]) -> Column:
    """Row c has a tombstone's set parts; set ones never match a null."""
    met = F.lit(True)
    for c in named:
        met &= F.col(f"c.{c}") == F.col(f"x.{c}")
    return met


def visible(content: DataFrame, tombstones: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Rows that no tombstone hides, whatever its status.

    A join for each level on all parts that it sets: on the project alone each row would meet all its project's tombstones.
    """
    kept = content
    for named, of in _by_level(tombstones):
        kept = kept.alias("c").join(small(of.select(*PARTS).distinct(), rows).alias("x"), _meets(named), "left_anti")
    return kept


def most_specific(hidden: DataFrame, tombstones: DataFrame, key: str, rows: int = SMALL_ROWS) -> DataFrame:
    """Each hidden row with the narrowest tombstone that hides it."""
    found = []
    for named, of in _by_level(tombstones):
        level = 3 if "session_id" in named else 2 if "workstream_id" in named else 1
        # One row for each scope: a scope's many tombstones are not joined with all its rows.
        best = of.groupBy(*named).agg(F.min(F.struct(F.lit(-level).alias("at"), "reason")).alias("_best"))
        found.append(hidden.alias("c").join(small(best, rows).alias("x"), _meets(named)).select(f"c.{key}", "x._best"))
    best = functools.reduce(DataFrame.union, found).groupBy(key).agg(F.min("_best").alias("_best"))
    return best.select(key, (-F.col("_best.at")).alias("level"), F.col("_best.reason").alias("reason"))


def scopes(projects: DataFrame, workstreams: DataFrame, sessions: DataFrame) -> DataFrame:
    """One table of all scopes: kind, scope_id, name and parts."""
    tables = [df.withColumn("scope_kind", F.lit(k)) for k, df in (("project", projects), ("workstream", workstreams), ("session", sessions))]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def candidate_score(query: str | None, name: Column, alias: Column) -> Column:
    """How well a scope's name or alias meets a query."""
    if not query:
        return F.lit(0.25)
    q = F.lit(query.lower())
    n = F.lower(name)
    return F.greatest(
        F.when(alias == q, 1.0).when(alias.startswith(q), 0.7).otherwise(0.0),
        F.when(n == q, 0.95).when(n.startswith(q), 0.8).when(n.contains(q), 0.6).otherwise(0.0),
    )


def candidates(all_scopes: DataFrame, aliases: DataFrame, query: str | None, limit: int = 20) -> DataFrame:
    """Scopes that meet the query, best first; without a query projects only."""
    base = all_scopes if query else all_scopes.filter("scope_kind = 'project'")
    joined = base.join(small(aliases), ["scope_kind", "scope_id"], "left")
    score = F.max(candidate_score(query, F.col("name"), F.coalesce(F.col("alias"), F.lit("")))).alias("score")
    found = joined.groupBy("scope_kind", "scope_id", "name").agg(score).filter("score > 0")
    return found.orderBy(F.desc("score"), "name", "scope_kind", "scope_id").limit(limit)


def ambiguous(found: DataFrame, margin: float = 0.05) -> DataFrame:
    """Candidates within the margin of the best, flagged if there are several."""
    top = found.agg(F.max("score").alias("top"))
    near = found.crossJoin(F.broadcast(top)).filter(F.col("score") >= F.col("top") - margin).drop("top")  # top is one row
    return near.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > 1)
