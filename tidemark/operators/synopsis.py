"""Extractive session synopses: labelled blocks, matching lines and eight bounded sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ids, text

# speakers' labels, sections in order, and what a line of a section matches.
LABELS = ("User", "Assistant", "Tool call", "Tool result")
SECTIONS = ("goal", "current_state", "constraints", "decisions", "recent_changes", "open_questions", "important_entities", "known_risks")
LINES = {
    "constraints": r"(?i)\b(must|cannot|can't|required?|constraint|only|never)\b",
    "decisions": r"(?i)\b(decision|decided|choose|chose|selected|agreed|instead of|supersed|replace)\b",
    "open_questions": r"(?i)(?:\?|\bTODO\b|\bfollow[- ]?up\b|\bremaining\b|\bnext step\b)",
    "important_entities": r"(?:[A-Za-z0-9_.-]+/(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+|\b[A-Za-z_$][\w$]*\.(?:ts|tsx|js|mjs|cjs|json|sql|md)\b)",
    "known_risks": r"(?i)\b(risk|error|exception|failed?|failure|blocked?|warning|regression)\b",
}
GOAL_BLOCKS, STATE_BLOCKS, RECENT_CHUNKS = 2, 3, 3
SECTION_CHARACTERS, SECTION_EVIDENCE = 1200, 5

_LINES = {name: text.ascii_bounds(p) for name, p in LINES.items()}


def labelled_blocks(shown: Column, label: str) -> Column:
    """Array of the trimmed texts under a speaker's label, each up to the next label; empty ones are left out."""
    pattern = rf"(?s)(?:^|\n\n){label}(?: \(continued\))?:\n(.*?)(?=\n\n(?:{'|'.join(LABELS)})(?: \(continued\))?:|\z)"
    return F.filter(F.transform(F.regexp_extract_all(shown, F.lit(pattern), 1), text.stripped), lambda s: s != "")


def _ranked(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows of each session; the limit on the rank is applied before the shuffle too."""
    by = Window.partitionBy("session_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")


def excerpts(chunks: DataFrame) -> DataFrame:
    """(session_id, name, at, chunk_id, no, excerpt): what each section may quote, in the order (at, chunk_id, no)."""
    shown = chunks.select("session_id", F.coalesce("observed_from", F.lit("")).alias("at"), "chunk_id", F.col("display_text").alias("_shown"))
    key = ("session_id", "at", "chunk_id")

    def said(label: str) -> DataFrame:
        return shown.select(*key, F.posexplode(labelled_blocks(F.col("_shown"), label)).alias("no", "excerpt"))

    forward = [F.asc(c) for c in ("at", "chunk_id", "no")]
    backward = [F.desc(c) for c in ("at", "chunk_id", "no")]
    recent = shown.select(*key, F.lit(0).alias("no"), F.col("_shown").alias("excerpt"))
    lines = shown.select(*key, F.posexplode(F.transform(F.split("_shown", "\n"), text.stripped)).alias("no", "excerpt")).filter("excerpt != ''")
    names = F.array_compact(F.array(*(F.when(F.col("excerpt").rlike(p), F.lit(name)) for name, p in _LINES.items())))
    parts = [
        _ranked(said("User"), GOAL_BLOCKS, *forward).withColumn("name", F.lit("goal")),
        _ranked(said("Assistant"), STATE_BLOCKS, *backward).withColumn("name", F.lit("current_state")),
        _ranked(recent, RECENT_CHUNKS, *backward).withColumn("name", F.lit("recent_changes")),
        lines.select(*key, "no", "excerpt", F.explode(names).alias("name")),
    ]
    columns = ("session_id", "name", "at", "chunk_id", "no", "excerpt")
    found = parts[0].select(*columns)
    for part in parts[1:]:
        found = found.unionByName(part.select(*columns))
    return found


def sections(chunks: DataFrame, most_characters: int = SECTION_CHARACTERS, most_evidence: int = SECTION_EVIDENCE) -> DataFrame:
    """(session_id, name, section, evidence_ids): distinct single-spaced excerpts, in order, that fit a section.

    At most most_evidence of them count, so a session's rows are cut to as many before they are gathered.
    The excerpt that reaches the character limit is cut and ends in an ellipsis.
    """
    flat = excerpts(chunks).withColumn("excerpt", text.single_spaced(F.col("excerpt"))).filter("excerpt != ''")
    place = F.struct("at", "chunk_id", "no")
    once = flat.groupBy("session_id", "name", "excerpt").agg(F.min(place).alias("_place"))
    by = Window.partitionBy("session_id", "name").orderBy("_place")
    first = once.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most_evidence)
    # Only the first excerpt can be cut and leave room, by the blank that is trimmed before its ellipsis.
    used = F.sum(F.least(F.length(_fitted(F.col("excerpt"), F.lit(most_characters))), F.lit(most_characters)) + 1).over(by.rowsBetween(Window.unboundedPreceding, -1))
    left = F.lit(most_characters) - F.coalesce(used - 1, F.lit(0))
    kept = first.withColumn("_left", left.cast("int")).filter("_left > 0").withColumn("_text", _fitted(F.col("excerpt"), F.col("_left")))
    items = F.array_sort(F.collect_list(F.struct("_n", "_text", "_place.chunk_id")))
    return kept.groupBy("session_id", "name").agg(items.alias("_items")).select(
        "session_id", "name", F.array_join("_items._text", "\n").alias("section"), F.col("_items.chunk_id").alias("evidence_ids")
    )


def _fitted(value: Column, most: Column) -> Column:
    cut = F.concat(F.rtrim(F.substring(value, F.lit(1), most - 1)), F.lit("…"))
    return F.when(F.length(value) <= most, value).when(most <= 1, F.substring(value, F.lit(1), most)).otherwise(cut)


def synopses(chunks: DataFrame, most_characters: int = SECTION_CHARACTERS, most_evidence: int = SECTION_EVIDENCE) -> DataFrame:
    """One memory of each session whose chunks (session_id, chunk_id, observed_from, observed_to, display_text) fill a section.

    memory_id, session_id, body (titled sections in their fixed order), evidence_ids, observed_from, observed_to.
    """
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("name"))
    title = F.translate(F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")), "_", " ")
    part = F.struct(rank.alias("rank"), F.concat(title, F.lit("\n"), F.col("section")).alias("body"), "evidence_ids")
    whole = sections(chunks, most_characters, most_evidence).groupBy("session_id").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    seen = chunks.groupBy("session_id").agg(
        F.min(F.least("observed_from", "observed_to")).alias("observed_from"), F.max(F.greatest("observed_from", "observed_to")).alias("observed_to")
    )
    return whole.join(seen, "session_id").select(
        ids.stable_id("memory", F.lit("session_synopsis"), F.col("session_id").cast("string")).alias("memory_id"),
        "session_id",
        F.array_join("_parts.body", "\n\n").alias("body"),
        F.array_distinct(F.flatten("_parts.evidence_ids")).alias("evidence_ids"),
        "observed_from",
        "observed_to",
    )
