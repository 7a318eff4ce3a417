"""Redaction of secrets, with spans in Arrow batches, and of local paths, with built-in functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED]"
MOST_CHARACTERS = 1_048_576
MOST_MATCHES = 10_000
#: Built-in formats and their reasons; fixed values.
BUILT_IN = (
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]{0,65536}?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "credential"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "credential"),
    (r"\bgh[pousr]_[A-Za-z0-9]{30,255}\b", "credential"),
    (r"\bAKIA[A-Z0-9]{16}\b", "credential"),
    (r"\bglpat-[A-Za-z0-9_-]{20,}\b", "credential"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{16,}\b", "credential"),
    (r"\bAIza[A-Za-z0-9_-]{30,}\b", "credential"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+\/-]{16,}={0,2}", "credential"),
    (r"(?i)\b(?:api[_-]?key|access[_-]?token|password|passwd|secret)\b\s*[:=]\s*[\"']?[^\s\"',;]{8,}", "secret"),
    (r"(?i)\b[a-z][a-z0-9+.-]*:\/\/[^/\s:@]+:[^/\s@]+@", "credential"),
    (r"(?i)\baws_secret_access_key\b\s*[:=]\s*[\"']?[A-Za-z0-9/+]{40}[\"']?", "secret"),
)
#: Which reason names a merged span; fixed order.
REASONS = ("credential", "secret", "custom")
_COMPILED = tuple((re.compile(p, re.ASCII), reason) for p, reason in BUILT_IN)
_SPANS = "text string, redactions array<struct<start:int,end:int,reason:string>>, failed string"


@dataclass(frozen=True)
class Rule:
    """A user's rule: a literal, or a pattern with flags from i, m, s."""

    value: str
    literal: bool = True
    flags: str = ""

    def compiled(self) -> re.Pattern:
        found = sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in set(self.flags))
        pattern = re.compile(re.escape(self.value) if self.literal else self.value, found)
        if pattern.fullmatch(""):
            raise ValueError("a rule must not match the empty text")
        return pattern


def redact(text: str, rules: Iterable[Rule] = ()) -> tuple[str | None, list[tuple[int, int, str]], str | None]:
    """(text, spans, failure): fails closed, without text, beyond the limits on length and matches."""
    if len(text) > MOST_CHARACTERS:
        return None, [], "too_long"
    found = []
    for pattern, reason in (*_COMPILED, *((r.compiled(), "custom") for r in rules)):
        for m in pattern.finditer(text):
            if m.end() > m.start():
                found.append((m.start(), m.end(), reason))
            if len(found) > MOST_MATCHES:
                return None, [], "too_many_matches"
    spans: list[list] = []
    for start, end, reason in sorted(found, key=lambda s: (s[0], s[1])):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
            spans[-1][2] = min(spans[-1][2], reason, key=REASONS.index)
        else:
            spans.append([start, end, reason])
    out, at = [], 0
    for start, end, _ in spans:
        out += [text[at:start], PLACEHOLDER]
        at = end
    return "".join([*out, text[at:]]), [tuple(s) for s in spans], None


def redact_column(df: DataFrame, column: str, out: str, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """df with out: struct (text, redactions, failed) of column; null stays null."""
    if len(rules) > 32:
        raise ValueError("at most 32 rules")

    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = [(None, [], None) if v is None else redact(v, rules) for v in values]
            yield pd.DataFrame(
                {
                    "text": pd.Series([r[0] for r in rows], dtype=object),
                    "redactions": [[{"start": s, "end": e, "reason": w} for s, e, w in r[1]] for r in rows],
                    "failed": pd.Series([r[2] for r in rows], dtype=object),
                }
            )

    return df.withColumn(out, run(F.col(column)))


def redact_text_only(value: Column) -> Column:
    """Built-in formats without spans, in the JVM."""
    for pattern, _ in BUILT_IN:
        value = F.regexp_replace(value, pattern, PLACEHOLDER.replace("$", r"\$"))
    return value


#: Rewrites of local paths, in order; fixed values.
PATH_REWRITES = (
    (r"(?i)([`\"'])(?:file:/{2,3}|[A-Za-z]:[\\/]|\\\\|/)[^`\"'<>\r\n]+\1", "$1[LOCAL_PATH]$1"),
    (r"(?i)\bfile:/{2,3}[^\s\"'<>]+", "[LOCAL_PATH]"),
    (r"(?:^|(?<=[\s(\"'=]))[A-Za-z]:[\\/](?:[^\s\"'<>|]+[\\/]?)+", "[LOCAL_PATH]"),
    (r"(?:^|(?<=[\s(\"'=]))\\\\[^\s\\/\"'<>|]+[\\/][^\s\"'<>|]+", "[LOCAL_PATH]"),
    (r"(?:^|(?<=[\s(\"'=]))/(?:[^\s/\"'<>|]+/)*[^\s\"'<>|]*", "[LOCAL_PATH]"),
)


def redact_paths(value: Column) -> Column:
    for pattern, to in PATH_REWRITES:
        value = F.regexp_replace(value, pattern, to)
    return value
