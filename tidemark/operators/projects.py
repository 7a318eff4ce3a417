"""Which project a session belongs to: candidates by level of trust, the most trusted level decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scope import small

#: Levels from most to least trusted; fixed order.
LEVELS = ("session", "metadata_remote", "repository_remote", "repository_root", "cwd_prefix", "inferred_remote", "inferred_root")


def is_prefix(prefix: Column, path: Column) -> Column:
    """Whether a folder holds a path (or is it)."""
    flat = F.regexp_replace(prefix, "/+$", "")
    return (path == flat) | path.startswith(F.concat(flat, F.lit("/")))


def mapped(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """(session_id, project_id, level) by explicit mappings (kind, value, project_id) of session, remote, root or folder."""
    rules = small(mappings)
    parts = []
    for level, (kind, column) in enumerate((("session", "session_id"), ("remote", "metadata_remote"), ("remote", "repository_remote"), ("root", "repository_root"))):
        rule = rules.filter(F.col("kind") == kind).select(F.col("value").alias("_v"), "project_id")
        parts.append(sessions.join(rule, F.col(column).cast("string") == F.col("_v")).select("session_id", "project_id", F.lit(level).alias("level")))
    folders = rules.filter("kind = 'folder'").select(F.col("value").alias("_v"), "project_id")
    met = sessions.join(folders, is_prefix(F.col("_v"), F.col("cwd")))
    longest = Window.partitionBy("session_id").orderBy(F.desc(F.length("_v")))
    kept = met.withColumn("_r", F.rank().over(longest)).filter("_r = 1")
    parts.append(kept.select("session_id", "project_id", F.lit(4).alias("level")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """(session_id, project_id, level, ambiguous): two projects on the deciding level are ambiguous and give none."""
    inferred = sessions.select(
        "session_id",
        F.coalesce(F.concat(F.lit("remote:"), "repository_remote"), F.concat(F.lit("root:"), "repository_root")).alias("project_id"),
        F.when(F.col("repository_remote").isNotNull(), 5).otherwise(6).alias("level"),
    ).filter("project_id is not null")
    both = mapped(sessions, mappings).unionByName(inferred)
    by_level = both.groupBy("session_id", "level").agg(F.min("project_id").alias("low"), F.max("project_id").alias("high"))
    best = by_level.groupBy("session_id").agg(F.min(F.struct("level", "low", "high")).alias("b"))
    unclear = F.col("b.low") != F.col("b.high")
    return best.select("session_id", F.when(~unclear, F.col("b.low")).alias("project_id"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("b.level") + 1).alias("level"), unclear.alias("ambiguous"))


def display_name(remote: Column, cwd: Column, project_id: Column) -> Column:
    """The last part of a remote, else of a folder, else of the identity."""
    leaf = lambda c: F.nullif(F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1), F.lit(""))
    return F.coalesce(leaf(remote), leaf(cwd), F.concat(F.lit("project "), F.right(project_id, F.lit(8))))
