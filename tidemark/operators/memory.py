"""Memories from chunks: decisions, their timeline, open items and extractive synopses."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ids, text

#: Words that say nothing about what a decision is on; fixed values.
STOP_WORDS = frozenset(
    "a an and as at be because by for from in instead is it of on or our the to use we will with".split()
)
RELATED = 0.2

# What a constraint, a rejected alternative and an entity look like.
CONSTRAINT = text.ascii_bounds(r"(?i)\b(must|cannot|can't|required?|constraint)\b")
INSTEAD = text.ascii_bounds(r"(?i)\binstead of\s+(.+)$")
REJECTED = (r"(?i)(?:we\s+)?rejected\s+(.+?)(?:\s+because\s+(.+))?$", r"(?i)^(.+?)\s+was rejected(?:\s+because\s+(.+))?$")
ENTITY = text.ascii_bounds(r"(?:[A-Za-z0-9_.-]+/)+(?:[A-Za-z0-9_.-]+)|\b[A-Za-z_$][\w$]*\.(?:ts|tsx|js|mjs|cjs|json|sql|md)\b")


def sentence_rows(chunks: DataFrame) -> DataFrame:
    """(session_id, chunk_id, observed_at, no, sentence) of chunks with display_text."""
    return chunks.select("session_id", "chunk_id", "observed_at", F.posexplode(text.sentences(F.col("display_text"))).alias("no", "sentence"))


def _rejected(sentence: Column) -> Column:
    """What a sentence says was rejected, and why; null where it says no such thing."""
    first, second = (sentence.rlike(p) for p in REJECTED)

    def part(n: int) -> Column:
        return F.nullif(F.when(first, F.regexp_extract(sentence, REJECTED[0], n)).otherwise(F.regexp_extract(sentence, REJECTED[1], n)), F.lit(""))

    made = F.struct(text.bounded(part(1), 300).alias("name"), text.bounded(part(2), 1200).alias("reason"))
    return F.when(sentence.rlike("(?i)rejected") & (first | second), made)


def decisions(chunks: DataFrame, most: int = 200) -> DataFrame:
    """Decision sentences with rationale, alternatives, constraints, entities, identity and what they say about earlier ones.

    A session has at most `most` decisions, the first in (observed_at, chunk_id, sentence), which bounds the timeline.
    """
    said = text.sentences(F.col("display_text"))
    beside = chunks.withColumn("_all", said).select(
        "session_id", "chunk_id", "observed_at", "_all",
        F.transform(F.slice(F.filter("_all", lambda s: s.rlike(CONSTRAINT)), 1, 8), lambda s: text.bounded(s, 300)).alias("constraints"),
        F.slice(F.filter(F.transform("_all", _rejected), lambda r: r.isNotNull()), 1, 8).alias("_rejected"),
    )
    rows = beside.select("session_id", "chunk_id", "observed_at", "constraints", "_rejected", F.posexplode("_all").alias("no", "sentence"))
    found = rows.withColumn("decided", text.decision(F.col("sentence"))).filter(F.col("decided").isNotNull())
    split = found.withColumn("_r", text.rationale(F.col("decided"))).withColumn("decision", text.bounded(F.col("_r.decision"), 1200)).filter("decision != ''")
    by = Window.partitionBy("session_id").orderBy(F.asc_nulls_first("observed_at"), "chunk_id", "no")
    first = split.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most)
    instead = F.nullif(F.regexp_extract("decision", INSTEAD, 1), F.lit(""))
    own = F.struct(text.bounded(instead, 300).alias("name"), F.lit(None).cast("string").alias("reason"))
    other = F.when(instead.isNull(), F.col("_rejected")).otherwise(F.slice(F.concat(F.array(own), F.col("_rejected")), 1, 8))
    told = first.withColumn("alternatives", other).withColumn("alternative", instead)
    lines = F.transform("alternatives", lambda r: F.concat(F.lit("Alternative rejected: "), r["name"], F.coalesce(F.concat(F.lit(" — "), r["reason"]), F.lit(""))))
    why = text.bounded(F.coalesce("_r.rationale", F.lit("No explicit rationale was captured.")), 1200)
    head = F.array(F.lit("Heuristic decision candidate; verify against the linked evidence."), F.concat(F.lit("Decision: "), F.col("decision")), F.concat(F.lit("Rationale: "), why))
    body = told.withColumn("body", F.array_join(F.concat(head, lines), "\n"))
    normalized = F.lower(text.single_spaced(text.nfkc(F.col("decision"))))
    return body.select(
        ids.stable_id("memory", F.lit("decision"), F.col("session_id").cast("string"), F.col("chunk_id").cast("string"), normalized).alias("memory_id"),
        "session_id", "chunk_id", "observed_at", "no", "decision",
        F.col("_r.rationale").alias("rationale"),
        "alternative", "alternatives", "constraints",
        F.slice(F.array_distinct(F.regexp_extract_all("sentence", F.lit(ENTITY), 0)), 1, 20).alias("entities"),
        F.concat(F.lit("Decision candidate: "), text.bounded(F.col("decision"), 120)).alias("title"),
        "body",
        F.col("body").rlike(text.SUPERSEDES).alias("supersedes_earlier"),
        (F.col("body").rlike(text.CONFLICTS) & ~F.col("body").rlike(text.SUPERSEDES)).alias("conflicts_earlier"),
    )


def identity_tokens(decision: str) -> frozenset[str]:
    """Runs of letters, digits, _ and - in compatibility normal form."""
    plain = unicodedata.normalize("NFKC", decision).lower()
    return frozenset(t for t in re.findall(r"[\w-]+", plain) if len(t) > 1 and t not in STOP_WORDS)


def timeline(found: DataFrame) -> DataFrame:
    """Status of each decision after its session's later ones: superseded, conflicted or candidate.

    A decision that replaces or contradicts marks the most similar earlier one, if similar enough, the
    first of equals. One session's decisions are folded in time order in one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_t=rows["observed_at"].fillna("")).sort_values(["_t", "memory_id"], kind="stable")
        out = [
            {"memory_id": r.memory_id, "session_id": r.session_id, "status": "candidate", "supersedes": [], "superseded_by": None} for r in rows.itertuples()
        ]
        tokens = [identity_tokens(d) for d in rows["decision"]]
        for i, r in enumerate(rows.itertuples()):
            if not (r.supersedes_earlier or r.conflicts_earlier):
                continue
            scores = [len(tokens[i] & t) / len(tokens[i] | t) if tokens[i] | t else 0.0 for t in tokens[:i]]
            if not scores or max(scores) < RELATED:
                continue
            k = scores.index(max(scores))
            if r.supersedes_earlier:
                out[i]["supersedes"].append(out[k]["memory_id"])
                out[k] |= {"status": "superseded", "superseded_by": out[i]["memory_id"]}
            else:
                out[i]["status"] = out[k]["status"] = "conflicted"
        return pd.DataFrame(out)

    narrow = found.select("memory_id", "session_id", "observed_at", "decision", "supersedes_earlier", "conflicts_earlier")
    made = T.StructType([narrow.schema["memory_id"], narrow.schema["session_id"]])
    for name, kind in (("status", T.StringType()), ("supersedes", T.ArrayType(T.StringType())), ("superseded_by", T.StringType())):
        made = made.add(name, kind)
    return narrow.groupBy("session_id").applyInPandas(run, made)


def open_items(chunks: DataFrame) -> DataFrame:
    """(session_id, item_kind, item): each session's first sentence of an open item's text."""
    kept = sentence_rows(chunks).withColumn("item_kind", text.open_item_kind(F.col("sentence"))).filter(F.col("item_kind").isNotNull())
    named = kept.withColumn("item", text.bounded(F.col("sentence"), 1200)).withColumn("_same", F.lower("item"))
    first = Window.partitionBy("session_id", "_same").orderBy("observed_at", "chunk_id", "no")
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("session_id", "chunk_id", "item_kind", "item")


def section(rows: DataFrame, session: str, order: list[Column], column: str, budget: int = 1200) -> DataFrame:
    """A synopsis section: distinct texts in order while their characters fit; the last one is cut to fit."""
    first = Window.partitionBy(session, column).orderBy(*order)
    once = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    by = Window.partitionBy(session).orderBy(*order)
    used = F.coalesce(F.sum(F.length(column)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitted = once.withColumn("_left", F.lit(budget) - used).filter("_left > 0")
    cut = fitted.withColumn("_text", F.substring(F.col(column), F.lit(1), F.col("_left").cast("int"))).withColumn("_no", F.row_number().over(by))
    return cut.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_text"))), lambda s: s["_text"]), "\n").alias("section"))


def evidence_faults(memories: DataFrame, known_chunks: DataFrame) -> DataFrame:
    """(memory_id, missing): evidence that does not exist; must be empty before a commit."""
    linked = memories.select("memory_id", F.explode("evidence_ids").alias("chunk_id"))
    return linked.join(known_chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("memory_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("missing"))


def diff(desired: DataFrame, existing: DataFrame, now: str, owned: list[str]) -> DataFrame:
    """What turns existing memories into desired ones: rows with change insert, update or delete.

    A memory whose content is as it was keeps its times and is no change; one that changed keeps
    derived_at and is updated now. Only memories of the extractors in `owned` are ever deleted.
    """
    times = ("derived_at", "updated_at")
    content = [c for c in desired.columns if c not in ("memory_id", *times)]
    d = desired.select("memory_id", F.struct(*content).alias("_d"), *(F.col(c).alias(f"_d_{c}") for c in times), F.lit(True).alias("_wanted"))
    e = existing.select("memory_id", F.struct(*content).alias("_e"), *(F.col(c).alias(f"_e_{c}") for c in times), F.lit(True).alias("_there"))
    both = d.join(e, "memory_id", "full")
    gone = F.col("_wanted").isNull()
    change = F.when(F.col("_there").isNull(), "insert").when(gone, "delete").when(~F.col("_d").eqNullSafe(F.col("_e")), "update")
    kept = both.withColumn("change", change).filter(F.col("change").isNotNull() & (~gone | F.col("_e.extractor_version").isin(*owned)))
    of = F.when(gone, F.col("_e")).otherwise(F.col("_d"))
    updated = F.when(F.col("change") == "update", F.lit(now)).when(gone, F.col("_e_updated_at")).otherwise(F.col("_d_updated_at"))
    return kept.select("memory_id", "change", *(of[c].alias(c) for c in content), F.coalesce("_e_derived_at", "_d_derived_at").alias("derived_at"), updated.alias("updated_at"))
