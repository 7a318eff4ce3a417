"""Incremental ingestion: lines to canonical events, committed once however often a batch is retried."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import ids, redaction
from tidemark.operators import sync
from tidemark.sources import rollouts

#: Characters of an event's text; fixed values.
TEXT_MOST = 1_048_576
CUT_MARK = "\n[OUTPUT TRUNCATED]"
RESETS = ("ROTATED", "TRUNCATED", "MISMATCH")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days after which a file without new lines is forgotten.
KEEP_DAYS = 90
KINDS = ("user_message", "assistant_message", "tool_call", "tool_result")


class EventTable:
    """A Parquet table of events whose manifest names its committed parts: a commit is one rename."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    @property
    def parts(self) -> dict[str, str]:
        path = f"{self.root}/manifest.json"
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def read(self, schema) -> DataFrame:
        parts = list(self.parts.values())
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def commit(self, batch: DataFrame, batch_id: str) -> None:
        parts = self.parts
        if batch_id in parts:
            return
        part = f"{self.root}/part-{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(part)
        staged = f"{self.root}/manifest-{uuid.uuid4().hex}.json"
        with open(staged, "w", encoding="utf-8") as f:
            json.dump(parts | {batch_id: part}, f)
        os.replace(staged, f"{self.root}/manifest.json")


def capped(value, most: int = TEXT_MOST):
    """A text of at most `most` characters; one that is cut ends in a mark."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - len(CUT_MARK)), F.lit(CUT_MARK)))


def candidates(lines: DataFrame) -> DataFrame:
    """What lines say, before their file's session is known: texts capped and redacted, faults named; sessions' own records stay.

    Nothing that a redaction covers goes on into a text or a hash. A record whose redaction fails keeps no
    text and has a fault, as have lines and records that cannot be read.
    """
    parsed = rollouts.parse_rollouts(lines)
    said = F.col("kind").isin(*KINDS) & F.col("error").isNull() & F.col("ignored").isNull() & ((F.length(F.trim("text")) > 0) | (F.col("kind") == "tool_result"))
    kept = parsed.filter(said | F.col("error").isNotNull() | (F.col("kind") == "session_meta"))
    clean = redaction.redact_column(kept.withColumn("text", F.when(said, capped(F.col("text")))), "text", "_clean")
    failed = said & (F.col("_clean.failed").isNotNull() | F.col("_clean.text").isNull())
    fault = F.coalesce("error", F.when(failed, "REDACTION_FAILED"))
    named = F.regexp_extract("path", r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    return clean.select(
        "path", "byte_start", "byte_end", "kind", "variant", "tool_call_id", "observed_at", "session_key", "record_key", "record_ordinal",
        F.when(fault.isNull(), F.col("_clean.text")).alias("text"),
        F.when(fault.isNull(), F.sha2(F.col("_clean.text"), 256)).alias("content_hash"),
        F.when(named != "", named).otherwise(F.col("path")).alias("fallback"),
        fault.alias("fault"),
    )


#: A message is a mirror of one of another form whose ordinal is no farther; fixed value.
MIRROR_DISTANCE = 8
_SETTLED = "path string, byte_start long, byte_end long, kind string, tool_call_id string, observed_at string, text string, content_hash string, record_key string, fault string, carried_session string, ordinal long"
_MESSAGES = ("user_message", "assistant_message")


@dataclass
class FileState:
    """What is known of a file so far: its session, how many records it had, and its latest messages."""

    session: str | None = None
    records: int = 0
    recent: list[list] = field(default_factory=list)  # (key, ordinal, variant) of accepted messages

    @classmethod
    def of(cls, stored: str | None) -> FileState:
        return cls(**json.loads(stored)) if stored else cls()

    def stored(self) -> str:
        return json.dumps({"session": self.session, "records": self.records, "recent": self.recent}, separators=(",", ":"))

    def mirrored(self, key: str, ordinal: int, variant: str) -> bool:
        """Whether a message repeats one in another form; if not, it is remembered."""
        for known, at, form in self.recent:
            if known == key and form != variant and abs(at - ordinal) <= MIRROR_DISTANCE:
                return True
        self.recent = [[k, o, v] for k, o, v in self.recent if k != key and abs(o - ordinal) <= MIRROR_DISTANCE] + [[key, ordinal, variant]]
        return False


def settle(rows: pd.DataFrame, state: FileState) -> pd.DataFrame:
    """A file's rows, in byte order, with their session and ordinal; mirrors and sessions' own records go.

    The ordinal is the record's own, else its number in the file. A file that begins anew begins without a session.
    """
    out = []
    for r in rows.sort_values(["byte_start", "byte_end"], kind="stable").to_dict("records"):
        r = {k: None if pd.isna(v) else v for k, v in r.items()}
        if r["fault"] in RESETS:  # told at the byte where the file begins, and of no bytes, so before its lines
            state.session, state.records, state.recent = None, 0, []
        if r["session_key"] is not None:
            state.session = r["session_key"]
        if r["fault"] is None:
            state.records += 1
        if r["kind"] == "session_meta" and r["fault"] is None:
            continue
        session = state.session or r["fallback"]
        ordinal = state.records if r["record_ordinal"] is None else int(r["record_ordinal"])
        if r["fault"] is None and r["kind"] in _MESSAGES:
            key = hashlib.sha256("\0".join(map(str, (session, r["kind"], r["tool_call_id"], r["content_hash"], (r["observed_at"] or "undated")[:19]))).encode()).hexdigest()
            if state.mirrored(key, ordinal, r["variant"]):
                continue
        out.append(r | {"carried_session": session, "ordinal": ordinal})
    columns = [c.split()[0] for c in _SETTLED.split(", ")]
    return pd.DataFrame(out, columns=columns if not out else None).reindex(columns=columns)


class FileFold(StatefulProcessor):
    """settle over a stream: the state of a file goes on from batch to batch until the file has been still for a while."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "value string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = FileState.of(self.state.get()[0] if self.state.exists() else None)
        # A batch has a bounded part of each file.
        made = settle(pd.concat(list(rows)), state)
        self.state.update((state.stored(),))
        yield made

    def close(self) -> None:
        pass


def _identified(settled: DataFrame) -> DataFrame:
    """Events and faults of settled rows, with identities."""
    session = ids.stable_id("session", F.lit("codex"), F.col("carried_session"))
    key = F.coalesce("record_key", F.concat_ws(":", "path", F.col("byte_start").cast("string"), "kind"))
    made = settled.withColumns({"session_id": session, "_key": key}).withColumn("event_id", ids.stable_id("event", F.col("session_id"), F.col("kind"), F.col("_key")))
    return made.select(
        "session_id", F.col("carried_session").alias("session_key"), "ordinal", "kind", "tool_call_id", "text", "observed_at", "path", "byte_start", "byte_end", "content_hash", "event_id", "fault"
    )


def canonical_events(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Events of a table of lines: session carried forward, texts capped and redacted, mirrors dropped, identities and hashes set.

    before: (path, session_key) of what was read of these files earlier; a file goes on with its last session.
    """
    rows = candidates(lines)
    if before is not None:  # a row for each file
        rows = rows.join(before.withColumnRenamed("session_key", "_before"), "path", "left").withColumn("fallback", F.coalesce("_before", "fallback")).drop("_before")
    settled = rows.groupBy("path").applyInPandas(lambda part: settle(part, FileState()), _SETTLED)
    return _identified(settled).filter("fault is null").drop("fault")


def commit_batch(table: EventTable, faults: EventTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of identified rows: collisions fail the batch, known events are passed over, faults are kept apart."""

    def run(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            faults.commit(rows.filter("fault is not null").select("path", "byte_start", "byte_end", "fault"), str(batch_id))
            events = rows.filter("fault is null").drop("fault")
            if events.isEmpty():
                return
            clashes = sync.dedupe_events(events, "event_id", ["session_id", "content_hash"]).filter("collision")
            old = table.read(events.schema).select("event_id", F.col("content_hash").alias("_old"))
            changed = events.join(old, "event_id").filter("content_hash != _old")
            if not clashes.isEmpty() or not changed.isEmpty():
                raise ValueError("an event identity carries two contents")
            table.commit(sync.append_new(old, events, "event_id"), str(batch_id))
        finally:
            rows.unpersist()

    return run


def ingest(spark: SparkSession, pattern: str, root: str, checkpoint: str, most_bytes: int = rollouts.BATCH_BYTES, keep_days: int = KEEP_DAYS) -> EventTable:
    """Read what is new in the files of a pattern, to the end, and commit it, at most most_bytes of each file in a batch.

    Files' states are in the stream's state store. Faults are a table of the same kind beside the events.
    """
    spark.dataSource.register(rollouts.JsonLinesSource)
    table = EventTable(spark, root)
    faults = EventTable(spark, f"{root}/faults")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        while True:  # a run takes one bounded batch; the last one finds nothing
            lines = spark.readStream.format("jsonl_log").option("path", pattern).option("most_bytes", most_bytes).option("checkpoint", checkpoint).load()
            rows = candidates(lines).groupBy("path")
            settled = rows.transformWithStateInPandas(FileFold(keep_days * 86_400_000), _SETTLED, "Append", "ProcessingTime")
            query = _identified(settled).writeStream.foreachBatch(commit_batch(table, faults)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            if not any(p.numInputRows for p in query.recentProgress):
                return table
    finally:
        spark.conf.set(name, before)
