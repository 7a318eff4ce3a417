"""Append-only JSON-lines logs: complete-line reading with byte offsets, and record parsing."""

from __future__ import annotations

import functools
import glob
import hashlib
import json
import os
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MOST_BYTES = 64 << 20
#: Bytes of a task, and of a file in a batch of a stream.
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 16 << 20
LINE_SCHEMA = "path string, byte_start long, byte_end long, line string, line_sha256 string, problem string"


def whole_lines(f: BinaryIO, most_bytes: int = MOST_BYTES) -> Iterator[tuple[int, int, str | None, str | None, str | None]]:
    """(start, end, text, hash, problem) of the lines from where f stands; a tail without its newline stays behind.

    A line longer than most_bytes is passed over with a problem, as is one that is not UTF-8.
    """
    at = f.tell()
    while line := f.readline(most_bytes + 1):
        end = at + len(line)
        if not line.endswith(b"\n"):
            if len(line) <= most_bytes:
                return  # unfinished
            while more := f.readline(1 << 20):
                end += len(more)
                if more.endswith(b"\n"):
                    break
            else:
                return
            yield at, end, None, None, "OVERSIZED_RECORD"
        else:
            body = line[:-1].removesuffix(b"\r")
            try:
                text, problem = body.decode("utf-8"), None
            except UnicodeDecodeError:
                text, problem = None, "INVALID_UTF8"
            yield at, end, text, hashlib.sha256(body).hexdigest(), problem
        at = end


def lines_between(path: str, start: int, stop: int, until: int) -> Iterator[tuple]:
    """The lines that begin in [start, stop) and end by `until`, as rows of LINE_SCHEMA."""
    with open(path, "rb") as f:
        if start:  # the line that holds the byte before belongs to the range before
            f.seek(start - 1)
            while (passed := f.readline(1 << 20)) and not passed.endswith(b"\n"):
                pass
        for at, end, *rest in whole_lines(f):
            if at >= stop or end > until:
                return
            yield (path, at, end, *rest)


def fingerprint(path: str) -> str:
    s = os.stat(path)
    return f"{s.st_dev}:{s.st_ino}"


#: Bytes before a cursor whose hash tells whether a file is still what was read.
TAIL_BYTES = 4096
BLOCK = 1 << 16


def tail_hash(path: str, offset: int) -> str:
    with open(path, "rb") as f:
        f.seek(max(0, offset - TAIL_BYTES))
        return hashlib.sha256(f.read(min(offset, TAIL_BYTES))).hexdigest()


def continuity(path: str, cursor: dict | None) -> tuple[int, str | None]:
    """Where to read on, and why a cursor was not kept: another file, a shorter one, or other bytes before it."""
    if not cursor:
        return 0, None
    if cursor["fingerprint"] != fingerprint(path):
        return 0, "ROTATED"
    if cursor["offset"] > os.path.getsize(path):
        return 0, "TRUNCATED"
    if cursor["tail"] != tail_hash(path, cursor["offset"]):
        return 0, "MISMATCH"
    return cursor["offset"], None


def lines_end(path: str, start: int, most: int | None) -> int:
    """Where the last line ends that does within `most` bytes from start, or else the first one after; start where none has ended.

    Blocks are looked at for line ends only; none is kept.
    """
    size = os.path.getsize(path)
    edge = size if most is None else min(size, start + most)
    with open(path, "rb") as f:
        at = edge
        while at > start:
            low = max(start, at - BLOCK)
            f.seek(low)
            if (found := f.read(at - low).rfind(b"\n")) >= 0:
                return low + found + 1
            at = low
        f.seek(edge)
        while block := f.read(BLOCK):
            if (found := block.find(b"\n")) >= 0:
                return f.tell() - len(block) + found + 1
    return start


class _Ranges(InputPartition):
    """One task's reading: problems to tell, and (path, start, stop, until) of byte ranges."""

    def __init__(self, ranges: list[tuple[str, int, int, int]], told: list[tuple]) -> None:
        super().__init__(ranges)
        self.ranges, self.told = ranges, told


def dealt(spans: list[tuple[str, int, int]], told: list[tuple], split_bytes: int) -> list[InputPartition]:
    """(path, start, end) spans as tasks of about split_bytes: long spans are cut, short ones put together."""
    parts, held, size = [], [], 0
    for path, start, end in spans:
        for at in range(start, end, split_bytes):
            stop = min(end, at + split_bytes)
            if held and size + stop - at > split_bytes:
                parts.append(_Ranges(held, []))
                held, size = [], 0
            held.append((path, at, stop, end))
            size += stop - at
    if held:
        parts.append(_Ranges(held, []))
    if told:
        parts.append(_Ranges([], told))
    return parts


def _read(partition: _Ranges) -> Iterator[tuple]:
    yield from partition.told
    for one in partition.ranges:
        yield from lines_between(*one)


class _BatchReader(DataSourceReader):
    def __init__(self, pattern: str, split_bytes: int) -> None:
        self.pattern, self.split_bytes = pattern, split_bytes

    def partitions(self) -> list[InputPartition]:
        return dealt([(p, 0, os.path.getsize(p)) for p in sorted(glob.glob(self.pattern, recursive=True))], [], self.split_bytes)

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are a cursor for each file. The driver plans byte ranges; tasks read them, so no line passes the driver.

    A batch takes at most most_bytes of each file (a longer line is taken whole). Where a stream goes on after a
    restart is read from the offsets in its checkpoint; where those cannot be read, the first batch takes all there is.
    """

    def __init__(self, pattern: str, most_bytes: int, split_bytes: int, checkpoint: str | None) -> None:
        self.pattern, self.most_bytes, self.split_bytes, self.checkpoint = pattern, most_bytes, split_bytes, checkpoint
        self.planned: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        self.planned = {}
        return {"files": "{}"}

    def _last_planned(self) -> dict[str, dict] | None:
        """The cursors of the newest batch that the checkpoint knows of."""
        folder = f"{(self.checkpoint or '').removeprefix('file:')}/offsets"
        batches = [int(n) for n in os.listdir(folder) if n.isdigit()] if self.checkpoint and os.path.isdir(folder) else []
        if not batches:
            return None
        with open(f"{folder}/{max(batches)}", encoding="utf-8") as f:
            return json.loads(json.loads(f.read().splitlines()[-1])["files"])

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = self._last_planned()
        cursors = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            at, most = (0, None) if self.planned is None else (continuity(path, self.planned.get(path))[0], self.most_bytes)
            end = lines_end(path, at, most)
            cursors[path] = {"fingerprint": fingerprint(path), "offset": end, "tail": tail_hash(path, end)}
        self.planned = cursors
        return {"files": json.dumps(cursors, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        spans, told = [], []
        for path, cursor in after.items():
            at, reason = continuity(path, before.get(path))
            if reason:
                told.append((path, at, at, None, None, reason))
            if at < cursor["offset"]:
                spans.append((path, at, cursor["offset"]))
        return dealt(spans, told, self.split_bytes)

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        return _read(partition)


class JsonLinesSource(DataSource):
    """spark.read / readStream .format("jsonl_log").option("path", glob): complete lines with byte spans.

    Options: split_bytes (of a task), most_bytes (of a file and batch), checkpoint (of the stream, to go on from).
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_log"

    def schema(self) -> str:
        return LINE_SCHEMA

    def _number(self, name: str, otherwise: int) -> int:
        return int(self.options.get(name, otherwise))

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options["path"], self._number("split_bytes", SPLIT_BYTES))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._number("most_bytes", BATCH_BYTES), self._number("split_bytes", SPLIT_BYTES), self.options.get("checkpoint"))


def _text(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "string")


def flat_content(payload: Column, path: str, most: int = 2 << 20) -> Column:
    """Message content: a string, or the text items of an array joined by line ends."""
    items = F.try_variant_get(payload, path, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(items, lambda i: i["text"].isNotNull()), lambda i: i["text"]), "\n")
    return F.substring(F.coalesce(F.when(items.isNotNull(), joined), _text(payload, path)), 1, most)


#: Records that are passed over, by type and by their payload's type; fixed values.
INTERNAL_RECORDS = ("turn_context", "token_usage_record", "world_state")
INTERNAL_ITEMS, INTERNAL_MESSAGES = ("reasoning",), ("token_count", "task_started", "task_complete", "thread_settings_applied")
CALLS = {"function_call": "arguments", "custom_tool_call": "input"}
RESULTS = ("function_call_output", "custom_tool_call_output")
#: Characters of a line, a message and an identifier; fixed values.
MOST_LINE, MOST_TEXT, MOST_IDENTIFIER = 4 << 20, 2 << 20, 512


def _kind_of(v: Column, path: str) -> Column:
    """The JSON kind of a part: STRING, OBJECT, ARRAY, VOID for null, or another; null where there is no such part."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _identifier(v: Column, *paths: str) -> Column:
    """The first of some parts that is a string of 1 to 512 characters."""
    return F.coalesce(*(F.when((_kind_of(v, p) == "STRING") & F.length(_text(v, p)).between(1, MOST_IDENTIFIER), _text(v, p)) for p in paths))


def judged(line: Column, v: Column) -> Column:
    """Struct (state, reason) of a record: accepted, ignored for a reason, or failed with a code. The first rule that is met holds.

    v: the line parsed. Rules name types of parts, never what they say.
    """
    outer, inner = _text(v, "$.type"), F.when(_kind_of(v, "$.payload.type") == "STRING", _text(v, "$.payload.type"))
    item, message = outer == "response_item", outer == "event_msg"
    content = _kind_of(v, "$.payload.content")
    parts = F.try_variant_get(v, "$.payload.content", "array<variant>")
    read = lambda e: (_text(e, "$.type").isin("text", "Text", "input_text", "output_text")) & (_kind_of(e, "$.text") == "STRING") & (F.length(_text(e, "$.text")) > 0)
    whole = F.when(content == "STRING", F.length(_text(v, "$.payload.content")).between(1, MOST_TEXT)).when(content == "ARRAY", F.exists(parts, read))
    unread = F.when(content == "STRING", F.length(_text(v, "$.payload.content")) > MOST_TEXT).when(content == "ARRAY", F.size(parts) > 0).otherwise(F.lit(False))
    named = _identifier(v, "$.payload.name", "$.payload.tool").isNotNull()
    given = functools.reduce(lambda a, b: a | b, ((inner == kind) & _kind_of(v, f"$.payload.{part}").isNotNull() for kind, part in CALLS.items()))
    told = functools.reduce(lambda a, b: a | b, ((_kind_of(v, f"$.payload.{p}") == "STRING") & F.length(_text(v, f"$.payload.{p}")).between(1, MOST_TEXT) for p in ("message", "text")))
    rules = [
        (F.length(line) == 0, "failed", "EMPTY_LINE"),
        (F.length(line) > MOST_LINE, "failed", "LINE_TOO_LONG"),
        (v.isNull(), "failed", "MALFORMED_JSON"),
        ((_kind_of(v, "$") != "OBJECT") | ~_is(_kind_of(v, "$.type"), "STRING"), "failed", "MISSING_TYPE"),
        (~_is(_kind_of(v, "$.payload"), "OBJECT"), "failed", "INVALID_RECORD"),
        (outer == "session_meta", "accepted", None),
        (outer.isin(*INTERNAL_RECORDS), "ignored", "internal_record"),
        (item & (inner == "message") & ~_text(v, "$.payload.role").isin("user", "assistant"), "ignored", "forbidden_role"),
        (item & (inner == "message") & _text(v, "$.payload.role").isNull(), "ignored", "forbidden_role"),
        (item & (inner == "message") & whole, "accepted", None),
        (item & (inner == "message"), "ignored", F.when(unread, "unsupported_content").otherwise("unsupported_record")),
        (item & inner.isin(*CALLS), F.when(named & given, "accepted").otherwise("failed"), F.when(~(named & given), "INVALID_RECORD")),
        (item & inner.isin(*RESULTS), F.when(_kind_of(v, "$.payload.output").isNotNull(), "accepted").otherwise("failed"), F.when(_kind_of(v, "$.payload.output").isNull(), "INVALID_RECORD")),
        (item & (inner == "web_search_call"), "accepted", None),
        (item & inner.isin(*INTERNAL_ITEMS), "ignored", "internal_record"),
        (message & inner.isin("user_message", "agent_message"), F.when(told, "accepted").otherwise("failed"), F.when(~F.coalesce(told, F.lit(False)), "INVALID_RECORD")),
        (message & (inner == "item_completed"), "ignored", "mirror_record"),
        (message & inner.isin(*INTERNAL_MESSAGES), "ignored", "internal_record"),
    ]
    made = lambda state, reason: F.struct(state if isinstance(state, Column) else F.lit(state), reason if isinstance(reason, Column) else F.lit(reason).cast("string"))
    chosen = F.when(F.coalesce(rules[0][0], F.lit(False)), made(*rules[0][1:]))
    for met, state, reason in rules[1:]:
        chosen = chosen.when(F.coalesce(met, F.lit(False)), made(state, reason))
    return chosen.otherwise(made("ignored", "unsupported_record")).cast("struct<state:string,reason:string>")


def _is(kind: Column, wanted: str) -> Column:
    return F.coalesce(kind == wanted, F.lit(False))


def parse_rollouts(lines: DataFrame) -> DataFrame:
    """(…, record_type, kind, session_key, record_key, tool_call_id, text, error, ignored) of raw lines: why a record failed or was passed over."""
    v = F.try_parse_json("line").alias("v")
    parsed = lines.withColumn("v", v)
    p = F.try_variant_get("v", "$.payload", "variant")
    outer, inner = _text(F.col("v"), "$.type"), _text(F.col("v"), "$.payload.type")
    role = _text(F.col("v"), "$.payload.role")
    is_call, is_result = inner.isin("function_call", "custom_tool_call"), inner.isin("function_call_output", "custom_tool_call_output")
    item, mirror = outer == "response_item", outer == "event_msg"
    kind = (
        F.when(outer == "session_meta", "session_meta")
        .when(item & (inner == "message") & (role == "user"), "user_message")
        .when(item & (inner == "message") & (role == "assistant"), "assistant_message")
        .when(item & (is_call | (inner == "web_search_call")), "tool_call")
        .when(item & is_result, "tool_result")
        .when(mirror & (inner == "user_message"), "user_message")
        .when(mirror & (inner == "agent_message"), "assistant_message")
    )
    called = F.concat(
        F.lit("tool: "), F.coalesce(_text(F.col("v"), "$.payload.name"), _text(F.col("v"), "$.payload.tool"), F.when(inner == "web_search_call", "web_search"), F.lit("unknown")),
        F.lit("\ninput: "), F.coalesce(_text(F.col("v"), "$.payload.arguments"), _text(F.col("v"), "$.payload.input"), _text(F.col("v"), "$.payload.action"), F.lit("")),
    )
    body = (
        F.when(kind == "tool_call", called)
        .when(kind == "tool_result", F.coalesce(_text(F.col("v"), "$.payload.output"), F.lit("")))
        .when(mirror, F.coalesce(_text(F.col("v"), "$.payload.message"), _text(F.col("v"), "$.payload.text")))
        .when(kind.isin("user_message", "assistant_message"), flat_content(F.col("v"), "$.payload.content"))
    )
    told = judged(F.col("line"), F.col("v"))
    error = F.coalesce("problem", F.when(told["state"] == "failed", told["reason"]))
    session = F.when(kind == "session_meta", F.coalesce(_text(F.col("v"), "$.payload.id"), _text(F.col("v"), "$.payload.session_id")))
    return parsed.select(
        *lines.columns,
        outer.alias("record_type"),
        kind.alias("kind"),
        F.when(mirror, "mirror").otherwise("item").alias("variant"),
        session.alias("session_key"),
        _text(F.col("v"), "$.payload.id").alias("record_key"),
        F.try_variant_get("v", "$.ordinal", "long").alias("record_ordinal"),
        _text(F.col("v"), "$.payload.call_id").alias("tool_call_id"),
        body.alias("text"),
        _text(F.col("v"), "$.timestamp").alias("observed_at"),
        error.alias("error"),
        F.when(F.col("problem").isNull() & (told["state"] == "ignored"), told["reason"]).alias("ignored"),
    )


def parse_history(lines: DataFrame) -> DataFrame:
    """(session_key, text, at, result): history lines are evidence, metadata only, or an error."""
    from tidemark.functions.text import iso_time

    v = F.try_parse_json("line")
    key = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ("session_id", "conversation_id", "thread_id", "id")))
    said = F.try_variant_get(v, "$.text", "string")
    at = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ("ts", "timestamp")))
    result = F.when(v.isNull(), "MALFORMED_JSON").when(key.isNull(), "MISSING_SESSION").when(F.trim(said) != "", "evidence").otherwise("metadata")
    return lines.select("path", "byte_start", key.alias("session_key"), said.alias("text"), iso_time(at).alias("at"), result.alias("result"))


def parse_session_index(lines: DataFrame) -> DataFrame:
    """(session_key, title, updated_at), the last line of a session kept."""
    v = F.try_parse_json("line")
    rows = lines.select(
        F.try_variant_get(v, "$.id", "string").alias("session_key"), F.try_variant_get(v, "$.thread_name", "string").alias("title"),
        F.try_variant_get(v, "$.updated_at", "string").alias("updated_at"), "byte_start",
    )
    return rows.filter("session_key is not null").groupBy("session_key").agg(F.max_by("title", "byte_start").alias("title"), F.max_by("updated_at", "byte_start").alias("updated_at"))
