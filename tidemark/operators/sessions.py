"""Sessions as users find them: references by any of their fields, upserts of scopes and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import normalize, text

REFERENCES = 20
#: Fields of a session that a reference may be found by.
SEARCHED = ("session_id", "title", "branch", "head_commit", "started_at", "last_activity_at")


def matches(query: str) -> Column:
    """Whether any searched field holds the query; an empty query matches every session."""
    wanted = F.lower(text.nfkc(F.trim(F.lit(query))))
    held = F.length(wanted) == 0
    for c in SEARCHED:
        held = held | F.coalesce(F.contains(F.lower(text.nfkc(F.col(c).cast("string"))), wanted), F.lit(False))
    return held


def references(sessions: DataFrame, query: str, most: int = REFERENCES) -> DataFrame:
    """(session_id, uri, title, subtitle, last_modified): the selected sessions that match, the latest first."""
    found = sessions.filter((F.col("availability") == "selected") & matches(query))
    latest = found.orderBy(F.coalesce("last_activity_at", F.lit("")).desc(), "session_id").limit(most)
    return latest.select(
        "session_id",
        normalize.session_uri(F.col("session_id")).alias("uri"),
        normalize.session_title(F.col("title"), F.col("last_activity_at"), F.col("started_at"), F.col("branch")).alias("title"),
        F.concat_ws(" · ", "project_name", "branch", F.substring("last_activity_at", 1, 10)).alias("subtitle"),
        F.col("last_activity_at").alias("last_modified"),
    )


def enrich_titles(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Known sessions with the latest title told for each; titles of unknown sessions are passed over."""
    latest = titles.groupBy("session_id").agg(F.max(F.struct("updated_at", "title"))["title"].alias("_title"))
    return sessions.join(latest, "session_id", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows by key, new ones before old ones and later ones before earlier; `kept` columns stay as first written."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    first = Window.partitionBy(*keys).orderBy("_new", order)
    firsts = {c: F.first(c).over(first) for c in kept}
    return both.withColumns(firsts | {"_n": F.row_number().over(last)}).filter("_n = 1").drop("_n", "_new")


def orphans(children: DataFrame, parents: DataFrame, parent: str, key: str) -> DataFrame:
    """Children that name a parent that is not there; must be empty before scopes are written."""
    return children.filter(F.col(parent).isNotNull()).join(parents.select(F.col(key).alias(parent)), parent, "left_anti")


def alias_rows(aliases: DataFrame) -> DataFrame:
    """Aliases in normal form with the digest that they are keyed by; forbidden ones go."""
    made = aliases.withColumn("alias", normalize.alias(F.col("alias"))).filter(F.col("alias").isNotNull())
    return made.withColumn("alias_key", F.sha2("alias", 256))


def latest_aliases(aliases: DataFrame, by: str, most: int) -> DataFrame:
    """Each scope's latest aliases, ties to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), "alias_key")
    return aliases.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def accepted_events(events: DataFrame, availability: DataFrame, allow_unmapped: bool = False) -> DataFrame:
    """events with `accepted`: whether their session is mapped and selected."""
    mapped = availability.select("session_id", (F.col("availability") == "selected").alias("_selected"))
    return events.join(mapped, "session_id", "left").withColumn("accepted", F.coalesce("_selected", F.lit(allow_unmapped))).drop("_selected")
