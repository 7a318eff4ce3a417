"""Text kernels as Column builders; Python only where Spark has no built-in (NFKC)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that fix results; fixed values.
TOKEN = r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
PATH = r"(?:\.{0,2}/)?(?:[\p{L}\p{N}_.@-]+/)+[\p{L}\p{N}_.@-]+"
SYMBOL = r"\b[A-Za-z_$][A-Za-z0-9_$]*(?:(?:::|\.|#)[A-Za-z_$][A-Za-z0-9_$]*)+\b"
IDENTIFIER = r"\b[A-Za-z_$][A-Za-z0-9_$-]{2,}\b"
ERROR_LINE = r"(?i)error|exception|failed|failure|panic|traceback|\bE[A-Z0-9_]{3,}\b"
SPEAKER = r"^(User|Assistant|Tool call|Tool result)(?: \(continued\))?:\s*"
DECISIONS = (
    r"(?i)^(?:decision\s*:\s*)(.+)$",
    r"(?i)^(?:we\s+)?decided(?:\s+to|\s+on)?\s+(.+)$",
    r"(?i)^we\s+(?:choose|chose|selected|agreed)(?:\s+to|\s+on)?\s+(.+)$",
    r"(?i)^(?:we\s+)?will\s+use\s+(.+)$",
)
SUPERSEDES = r"(?i)\b(instead of|supersed(?:e|es|ed|ing)|replac(?:e|es|ed|ing)|no longer use|switch(?:ed|ing)? from)\b"
CONFLICTS = r"(?i)\b(conflicts? with|contradicts?)\b"
RESOLVED = r"(?i)\b(done|completed|resolved|fixed)\b"
OPEN_ITEMS = (
    ("question", r"(?i)^(?:open|unanswered) question\s*:"),
    ("risk", r"(?i)^(?:known )?(?:risk|blocker)\s*:|\bremains? blocked\b"),
    ("deferred_decision", r"(?i)^(?:deferred decision|defer)\s*:|\bdefer(?:red)? until\b"),
    ("follow_up", r"(?i)^(?:follow[- ]?up|next step|remaining)\s*:|\bneed to follow up\b"),
    ("todo", r"^TODO\s*:|(?i)\b(?:still )?need to\b|\bremains? to be\b"),
)
INTENTS = (
    ("exact_error", r"\b(?:TypeError|RangeError|ReferenceError|SyntaxError|Exception|Traceback|panic:)\b|\b(?:ERR_|E[A-Z0-9_]{3,}|HTTP\s+[45]\d\d|exit code \d+)\b|(?i)(?:error|exception|failed|failure|panic|traceback)\s*[:\-]\s*\S+"),
    ("exact_identifier", r"(?:\.{0,2}/)?(?:[\p{L}\p{N}_.@-]+/)+[\p{L}\p{N}_.@-]+|\b[A-Za-z_$][A-Za-z0-9_$]*(?:(?:::|\.|#)[A-Za-z_$][A-Za-z0-9_$]*)+\b|[`'\"][A-Za-z_$][A-Za-z0-9_$-]{2,}[`'\"]"),
    ("decision_rationale", r"(?i)\b(?:why|rationale|reason|decid(?:e|ed|ing)|reject(?:ed|ion)?|trade[ -]?off)\b"),
    ("debugging_history", r"(?i)\b(?:debug(?:ging)?|troubleshoot|attempt(?:ed|s)?|tried|failure history|what failed)\b"),
    ("chronology", r"(?i)\b(?:timeline|chronolog(?:y|ical)|when|before|after|sequence|history of)\b"),
    ("open_items", r"(?i)\b(?:todo|to-do|open item|open question|remaining|follow[ -]?up|next step|what(?:'s| is) left)\b"),
    ("latest_state", r"(?i)\b(?:latest|current|present state|where (?:are|did) we|status now|most recent)\b"),
    ("broad_synthesis", r"(?i)\b(?:overview|summar(?:y|ize)|recap|big picture|across (?:the )?(?:project|workstream|sessions?))\b"),
)
#: Letters with marks and what they are searched as; a fixed value, in pairs.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds between ASCII word characters and others, whatever the JVM's own rule."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


#: The same patterns in Python, with ASCII word bounds and white space: they name ASCII signs alone, so both engines agree.
_SYMBOL, _IDENTIFIER, _ERROR_LINE = (re.compile(p, re.ASCII) for p in (SYMBOL, IDENTIFIER, ERROR_LINE))
#: What every symbol holds.
_JOINT = re.compile(r"[:.#][A-Za-z_$]")
_WHITE, _LINE_ENDS = " \t\n\r\f\v", "\u0085\u2028\u2029"

PATH, SYMBOL, IDENTIFIER, ERROR_LINE, SUPERSEDES, CONFLICTS, RESOLVED = map(
    ascii_bounds, (PATH, SYMBOL, IDENTIFIER, ERROR_LINE, SUPERSEDES, CONFLICTS, RESOLVED)
)
OPEN_ITEMS = tuple((k, ascii_bounds(p)) for k, p in OPEN_ITEMS)
INTENTS = tuple((k, ascii_bounds(p)) for k, p in INTENTS)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def nfkc(value: Column) -> Column:
    """Compatibility normal form; plain ASCII never leaves the JVM."""
    return F.when(value.rlike(r"[^\x00-\x7F]"), _nfkc(value)).otherwise(value)


def token_count(value: Column) -> Column:
    """Pieces of up to four letters, up to three digits, or one other sign."""
    return F.coalesce(F.regexp_count(value, F.lit(TOKEN)), F.lit(0))


def search_tokens(value: Column) -> Column:
    """Lower-case runs of letters and digits, marks dropped."""
    return F.regexp_extract_all(F.translate(F.lower(value), MARKED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def single_spaced(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def bounded(value: Column, most: int) -> Column:
    """Single-spaced text of at most `most` characters, an ellipsis for what is cut."""
    flat = single_spaced(value)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def normal_term(value: Column) -> Column:
    return F.lower(stripped(nfkc(value)))


def _stripped(value: str) -> str:
    """`stripped` in Python: the JVM's $ also stands before a last line end, which stays."""
    end = value[-1:] if value.endswith(tuple(_LINE_ENDS)) else ""
    return value[: len(value) - len(end)].strip(_WHITE) + end


def normal_form(value: str) -> str:
    """normal_term of a value of `exact_values`, which has no white space at its ends before its normal form."""
    return value.lower() if value.isascii() else _stripped(unicodedata.normalize("NFKC", value)).lower()


def exact_values(value: str | None, paths: list[str] | None) -> tuple[list[str], ...]:
    """Paths (given), symbols, identifiers and error lines of a text, as `exact_terms` finds them."""
    if value is None:
        return ()
    lines = (_stripped(line) for line in value.replace("\r\n", "\n").split("\n"))
    lines = [line for line in lines if 4 <= len(line) <= 512 and _ERROR_LINE.search(line)]
    return paths or [], _SYMBOL.findall(value) if _JOINT.search(value) else [], _IDENTIFIER.findall(value), lines


def paths(value: Column) -> Column:
    """All paths: one starts where no sign of a name stands before it, so other places are not tried."""
    return F.when(value.contains("/"), F.regexp_extract_all(value, F.lit(rf"((?<![\p{{L}}\p{{N}}_.@-]){PATH})"), 1))


def exact_terms(value: Column) -> Column:
    """Array of (kind, value) of paths, symbols, identifiers and error lines, in that order, repeats included."""

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    lines = F.filter(
        F.transform(F.split(value, r"\r?\n"), stripped), lambda s: (F.length(s) >= 4) & (F.length(s) <= 512) & s.rlike(ERROR_LINE)
    )
    found = F.concat(
        *(of(kind, F.regexp_extract_all(value, F.lit(f"({p})"), 1)) for kind, p in (("path", PATH), ("symbol", SYMBOL), ("identifier", IDENTIFIER))),
        of("error", lines),
    )
    return found


def sentences(value: Column) -> Column:
    """Pieces between line ends and after sentence ends, trimmed, of three characters or more."""
    pieces = F.split(F.replace(value, F.lit("\r")), r"\n+|(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, stripped), lambda s: F.length(s) >= 3)


def intent(query: Column) -> Column:
    """The first rule that a query meets names its intent."""
    flat = single_spaced(query)
    chosen = F.when(flat.rlike(INTENTS[0][1]), F.lit(INTENTS[0][0]))
    for name, pattern in INTENTS[1:]:
        chosen = chosen.when(flat.rlike(pattern), F.lit(name))
    return chosen.otherwise(F.lit("general"))


def open_item_kind(sentence: Column) -> Column:
    said = F.trim(F.regexp_replace(sentence, SPEAKER, ""))
    chosen = F.when(said.rlike(OPEN_ITEMS[0][1]), F.lit(OPEN_ITEMS[0][0]))
    for name, pattern in OPEN_ITEMS[1:]:
        chosen = chosen.when(said.rlike(pattern), F.lit(name))
    return F.when(~sentence.rlike(RESOLVED), chosen)


def decision(sentence: Column) -> Column:
    """What a sentence decides, or null."""
    said = F.regexp_replace(sentence, SPEAKER, "")
    found = [F.trim(F.regexp_extract(said, p, 1)) for p in DECISIONS]
    return F.coalesce(*(F.when(F.length(f) >= 3, f) for f in found))


def rationale(decided: Column) -> Column:
    """(decision, rationale) split at the first because."""
    pattern = r"(?is)^(.*?)\s+because\s+(.+)$"
    met = decided.rlike(pattern)
    return F.struct(
        F.when(met, F.trim(F.regexp_extract(decided, pattern, 1))).otherwise(decided).alias("decision"),
        F.when(met, F.trim(F.regexp_extract(decided, pattern, 2))).alias("rationale"),
    )


def iso_time(value: Column) -> Column:
    """Epoch seconds (below 1e10) or milliseconds, or ISO text, as UTC ISO text with milliseconds; else null."""
    number = value.try_cast("double")
    at = F.when(number.isNotNull(), F.timestamp_millis(F.when(number < 1e10, number * 1000).otherwise(number).cast("long"))).otherwise(
        F.try_to_timestamp(value)
    )
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
