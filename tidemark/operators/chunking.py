"""From ordered events to chunks: tool pairs, turn groups, repeated lines, greedy packing."""

from __future__ import annotations

import itertools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ids, text

TOOL_OUTPUT = 65_536
#: Versions that a chunk's fingerprint holds: a new one makes all chunks new.
CHUNKER_VERSION, REDACTION_VERSION = "chunks-2", "redaction-1"
#: A split goes back to the last line end or space if that keeps this share of the text.
USEFUL = 0.6
LABELS = {"user_message": "User", "assistant_message": "Assistant", "tool_call": "Tool call", "tool_result": "Tool result"}


def tool_pairs(events: DataFrame, session: str, order: list[str], call_id: str = "tool_call_id") -> DataFrame:
    """Calls with results, first in first out for each session and call id.

    A result without an open call is left over: it takes the running sum of calls less results
    to a new low. The n-th result that is not left over answers the n-th call.
    """
    step = F.when(F.col("kind") == "tool_call", 1).when(F.col("kind") == "tool_result", -1)
    own = events.filter(F.col(call_id).isNotNull() & F.col("kind").isin("tool_call", "tool_result")).withColumn("_step", step)
    by = Window.partitionBy(session, call_id).orderBy(*order)
    sums = own.withColumn("_sum", F.sum("_step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.coalesce(F.min("_sum").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = sums.withColumn("_left_over", (F.col("_step") < 0) & (F.col("_sum") < F.least(low, F.lit(0))))
    ranked = marked.filter(~F.col("_left_over")).withColumn(
        "_n", F.row_number().over(Window.partitionBy(session, call_id, "kind").orderBy(*order))
    )
    calls = ranked.filter("kind = 'tool_call'").select(session, call_id, "_n", F.col("event_id").alias("call_event"), F.struct(*order).alias("call_at"))
    results = ranked.filter("kind = 'tool_result'").select(session, call_id, "_n", F.col("event_id").alias("result_event"), F.struct(*order).alias("result_at"))
    return calls.join(results, [session, call_id, "_n"]).drop("_n")


def turn_groups(events: DataFrame, pairs: DataFrame | None, session: str, order: list[str]) -> DataFrame:
    """events with turn: groups start at user messages, unless one stands between a call and its result."""
    by = Window.partitionBy(session).orderBy(*order)
    numbered = events.withColumn("position", F.row_number().over(by))
    if pairs is not None:
        at = numbered.select(session, F.col("event_id"), "position")
        spans = pairs.join(at.withColumnsRenamed({"event_id": "call_event", "position": "_from"}), [session, "call_event"]).join(
            at.withColumnsRenamed({"event_id": "result_event", "position": "_to"}), [session, "result_event"]
        )
        edges = spans.select(session, (F.col("_from") + 1).alias("position"), F.lit(1).alias("_d")).union(
            spans.select(session, F.col("_to") + 1, F.lit(-1))
        )
        net = edges.groupBy(session, "position").agg(F.sum("_d").alias("_d"))
        numbered = numbered.join(net, [session, "position"], "left")
    else:
        numbered = numbered.withColumn("_d", F.lit(0))
    along = Window.partitionBy(session).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    open_spans = F.sum(F.coalesce("_d", F.lit(0))).over(along)
    starts = numbered.withColumn("_open", open_spans).withColumn(
        "_start", ((F.col("position") == 1) | ((F.col("kind") == "user_message") & (F.col("_open") == 0))).cast("int")
    )
    return starts.withColumn("turn", F.sum("_start").over(along) - 1).drop("_d", "_open", "_start")


def repeated_line_runs(docs: DataFrame, key: str, column: str, more_than: int = 3) -> DataFrame:
    """(key, first_line, line, run_length): runs of equal non-empty lines longer than more_than."""
    lines = docs.select(key, F.posexplode(F.split(column, "\n", -1)).alias("no", "line"))
    by = Window.partitionBy(key).orderBy("no")
    changed = F.coalesce((F.col("line") != F.lag("line").over(by)).cast("int"), F.lit(1))
    islands = lines.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(key, "_run", "line").agg(F.min("no").alias("first_line"), F.count(F.lit(1)).alias("run_length"))
    return runs.filter((F.col("run_length") > more_than) & (F.length("line") > 0)).drop("_run")


def line_runs(value: Column) -> Column:
    """Array of (line, n): the maximal runs of equal lines of a text, in order."""
    lines = F.split(value, "\n", -1)
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (F.element_at(lines, i) != F.element_at(lines, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines) + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(lines, a).alias("line"), (b - a).alias("n")))


def compact_lines(value: Column, more_than: int = 3) -> Column:
    """(text, omitted): runs of equal lines cut to two and a marker, and the characters that this left out."""
    runs = line_runs(value)
    is_cut = lambda r: (r["n"] > more_than) & (F.length(r["line"]) > 0)
    marker = lambda r: F.concat(F.lit("... ["), (r["n"] - 2).cast("string"), F.lit(" repeated lines omitted] ..."))
    shown = F.transform(runs, lambda r: F.when(is_cut(r), F.array(r["line"], r["line"], marker(r))).otherwise(F.array_repeat(r["line"], r["n"])))
    left_out = F.aggregate(runs, F.lit(0), lambda sum_, r: sum_ + F.when(is_cut(r), (F.length(r["line"]) + 1) * (r["n"] - 2)).otherwise(0))
    return F.struct(F.array_join(F.flatten(shown), "\n").alias("text"), left_out.alias("omitted"))


def one_line_end(value: Column) -> Column:
    return F.regexp_replace(value, "\r\n?", "\n")


def compact_output(value: Column, most: int) -> Column:
    """(text, repeated, beyond): tool output within most characters, as head, error lines and tail around omission markers.

    repeated and beyond are the characters that repeated lines and the limit left out.
    """
    compacted = compact_lines(one_line_end(value))
    flat = compacted["text"]
    marker = "\n... [output omitted] ...\n"
    errors = F.array_join(F.filter(F.split(flat, "\n"), lambda s: s.rlike(r"(?i)error|exception|fail(?:ed|ure)?|fatal|panic|traceback")), "\n")
    markers = F.when(F.length(errors) == 0, 1).otherwise(2)
    source = F.greatest(F.lit(0), F.lit(most) - len(marker) * markers)
    for_errors = F.least(F.floor(source * 0.5), F.length(errors)).cast("int")
    edges = (source - for_errors).cast("int")
    head, tail = F.ceil(edges / 2).cast("int"), F.floor(edges / 2).cast("int")
    middle = F.when(for_errors == 0, F.lit(marker)).otherwise(F.concat(F.lit(marker), F.substring(errors, F.lit(1), for_errors), F.lit(marker)))
    ends = F.when(tail == 0, F.lit("")).otherwise(F.substring(flat, F.length(flat) - tail + 1, tail))
    fits = F.length(flat) <= most
    return F.struct(
        F.when(fits, flat).otherwise(F.concat(F.substring(flat, F.lit(1), head), middle, ends)).alias("text"),
        compacted["omitted"].alias("repeated"),
        F.when(fits, 0).otherwise(F.greatest(F.lit(1), F.length(flat) - source)).alias("beyond"),
    )


def _label(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[kind]


def flat_text(value: Column) -> Column:
    """A text as it is embedded: compatibility normal form in single spaces."""
    return text.single_spaced(text.nfkc(value))


def event_text(kind: Column, value: Column) -> Column:
    """An event as it is embedded."""
    return F.concat(_label(kind), F.lit(": "), value)


def event_display(kind: Column, value: Column) -> Column:
    """An event as it is shown."""
    return F.concat(_label(kind), F.lit(":\n"), value)


_TOKEN = regex.compile(text.TOKEN)
EMPTY = "[empty output]"


def _flat(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split())


def _cost(value: str) -> int:
    """Tokens of a text's embedding form."""
    return len(_TOKEN.findall(_flat(value)))


def _longest_prefix(body: str, most: int) -> int:
    """The characters of the longest beginning of body that has at most `most` tokens; its whole length if all fits."""
    if unicodedata.is_normalized("NFKC", body):
        # A beginning's tokens are those that start in it.
        after = next(itertools.islice(_TOKEN.finditer(body), most, None), None)
        return len(body) if after is None else after.start()
    high = 1
    while high < len(body) and _cost(body[:high]) <= most:
        high *= 2
    low, high = high // 2, min(high, len(body))
    while low < high:
        middle = -(-(low + high) // 2)
        low, high = (middle, high) if _cost(body[:middle]) <= most else (low, middle - 1)
    return low


def split_text(label: str, body: str, most: int) -> list[tuple[str, str]]:
    """body in parts, each as it is shown and as it is embedded, that have at most `most` tokens with their label.

    Parts after the first are marked as continued. Only a part's own tokens are looked at for it.
    """
    if not body:
        return [(f"{label}:\n{EMPTY}", f"{label}: {EMPTY}")]
    parts: list[tuple[str, str]] = []
    at = 0
    while at < len(body):
        head = f"{label}{' continued' if parts else ''}: "
        room = most - len(_TOKEN.findall(head))
        # A token has at most four characters, so more than this is only looked at where white space is long.
        size = 8 * most
        while True:
            window = body[at : at + size]
            low = _longest_prefix(window, room) if room > 0 else 0
            if low < len(window) or at + size >= len(body):
                break
            size *= 4
        if not low:
            raise ValueError("the token limit is too small for an event's label")
        if at + low < len(body):
            edge = max(body.rfind("\n", at, at + low), body.rfind(" ", at, at + low)) - at
            low = edge + 1 if edge >= int(low * USEFUL) else low
        chosen = body[at : at + low]
        parts.append((f"{label}{' (continued)' if parts else ''}:\n{chosen}", head + _flat(chosen)))
        at += low
        while at < len(body) and body[at].isspace():
            at += 1
    return parts


_PARTS = "array<struct<shown string, embedding string>>"


def event_parts(kind: Column, value: Column, tokens: Column, most: int) -> Column:
    """An event's text in parts (shown, embedding) of at most `most` tokens; only longer ones leave the JVM."""

    @F.pandas_udf(_PARTS)
    def split(labels: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"shown": s, "embedding": e} for s, e in split_text(a, b, most)] for a, b in zip(labels, bodies)])

    said = F.when(F.length(value) == 0, EMPTY).otherwise(value)
    whole = F.array(F.struct(event_display(kind, said).alias("shown"), event_text(kind, flat_text(said)).alias("embedding")))
    return F.when(tokens > most, split(_label(kind), value)).otherwise(whole)


def pack_turns(parts: DataFrame, session: str, target: int = 600, most: int = 900) -> DataFrame:
    """(session, turn, part, sequence) from (session, turn, part, tokens): greedy packing of whole turns.

    A chunk is closed when it has reached target, or the next turn would take it past most; a turn that
    is larger than most is packed part by part. Without a column `part` each turn is one part. The fold is
    over one session's parts, whose number is bounded by the session's.
    """
    whole = parts if "part" in parts.columns else parts.withColumn("part", F.lit(0))
    by_turn = Window.partitionBy(session, "turn")
    sized = whole.withColumns({"_group": F.sum("tokens").over(by_turn), "_first": F.min("part").over(by_turn)})
    item = F.struct("turn", "part", F.col("tokens").cast("long").alias("tokens"), F.col("_group").cast("long").alias("group"), (F.col("part") == F.col("_first")).alias("first"))
    ordered = sized.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sequence"), F.lit(0).cast("bigint").alias("held"))

    def step(s: Column, t: Column) -> Column:
        at_turn = (s["held"] > 0) & t["first"] & ((s["held"] >= target) | (s["held"] + t["group"] > most))
        inside = ~at_turn & (s["held"] > 0) & (t["group"] > most) & (s["held"] + t["tokens"] > most)
        close = at_turn | inside
        sequence = s["sequence"] + close.cast("bigint")
        return F.struct(F.concat(s["out"], F.array(sequence)).alias("out"), sequence.alias("sequence"), (F.when(close, F.lit(0)).otherwise(s["held"]) + t["tokens"]).alias("held"))

    folded = ordered.select(session, "_items", F.aggregate("_items", start, step, lambda s: s["out"]).alias("_out"))
    packed = folded.select(session, F.explode(F.arrays_zip("_items", "_out")).alias("p"))
    found = packed.select(session, F.col("p._items.turn").cast("long").alias("turn"), F.col("p._items.part").alias("part"), F.col("p._out").alias("sequence"))
    return found if "part" in parts.columns else found.drop("part")


def prepared(events: DataFrame, most_output: int = TOOL_OUTPUT) -> DataFrame:
    """events with _body, their text with one kind of line end and tools' output compacted, and what that left out."""
    said = F.coalesce("text", F.lit(""))
    output = F.when(F.col("kind") == "tool_result", compact_output(said, most_output))
    omitted = lambda reason, n: F.when(n > 0, F.struct("event_id", F.lit(reason).alias("reason"), n.cast("long").alias("characters")))
    left_out = F.array_compact(F.array(omitted("repetitive_output", F.col("_output.repeated")), omitted("output_limit", F.col("_output.beyond"))))
    with_output = events.withColumn("_output", output)
    return with_output.withColumns({"_body": F.coalesce("_output.text", one_line_end(said)), "_omissions": left_out}).drop("_output")


def chunks(
    events: DataFrame, session: str, order: list[str], target: int = 600, most: int = 900, chunker: str = CHUNKER_VERSION, redaction: str = REDACTION_VERSION
) -> DataFrame:
    """Chunks of a session's events (event_id, kind, text, observed_at): ordered ids, both texts, tokens, omissions and fingerprint.

    A user's message between a tool's call and its result stays in their turn (events with tool_call_id);
    a tool's output is compacted; an event of more than `most` tokens is split. The fingerprint is of the
    embedded text, the events and both versions.
    """
    pairs = tool_pairs(events, session, order) if "tool_call_id" in events.columns else None
    grouped = turn_groups(prepared(events), pairs, session, order)
    counted = grouped.withColumn("_tokens", text.token_count(event_text(F.col("kind"), flat_text(F.col("_body")))))
    split = counted.select("*", F.posexplode(event_parts(F.col("kind"), F.col("_body"), F.col("_tokens"), most)).alias("_no", "_part"))
    split = split.withColumn("tokens", text.token_count(F.col("_part.embedding"))).withColumn("part", F.struct("position", "_no"))
    placed = split.join(pack_turns(split.select(session, "turn", "part", "tokens"), session, target, most), [session, "turn", "part"])
    made = placed.groupBy(session, "sequence").agg(
        F.array_sort(F.collect_list(F.struct("position", "_no", "event_id", "_part", "_omissions"))).alias("parts"),
        F.sum("tokens").alias("token_count"),
        F.min("observed_at").alias("observed_from"),
        F.max("observed_at").alias("observed_to"),
    )
    made = made.withColumns(
        {
            "event_ids": F.array_distinct("parts.event_id"),
            "display_text": F.array_join("parts._part.shown", "\n\n"),
            "embedding_text": F.array_join("parts._part.embedding", "\n\n"),
            "omissions": F.array_distinct(F.flatten("parts._omissions")),
        }
    )
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    ends = F.array(F.col(session).cast("string"), first["event_id"], first["_no"].cast("string"), last["event_id"], last["_no"].cast("string"))
    told = F.concat(F.array("embedding_text"), F.col("event_ids"), F.array(F.lit(chunker), F.lit(redaction)))
    return made.withColumn("chunk_id", ids.stable_id_of_array("chunk", F.concat(ends, F.col("event_ids")))).withColumn("fingerprint", F.sha2(ids.encode_array(told), 256)).drop("parts")
