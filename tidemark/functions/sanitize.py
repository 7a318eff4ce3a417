"""Nested JSON made fit to be shown: every string and key redacted, size and depth bounded, one canonical form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import redaction

#: Bounds of a value; fixed values.
MOST_DEPTH, MOST_NODES = 32, 20_000
MOST_BYTES = 131_072
FAULTS = ("MALFORMED_JSON", "TOO_DEEP", "TOO_MANY_NODES", "TOO_LARGE", "KEY_COLLISION", "REDACTION_FAILED")

_PATHS = tuple((re.compile(p, re.ASCII), to.replace("$1", r"\1")) for p, to in redaction.PATH_REWRITES)


class Unfit(Exception):
    """A value that cannot be shown, by one of FAULTS."""


def clean_text(value: str) -> str:
    found, _, failure = redaction.redact(value)
    if failure:
        raise Unfit("REDACTION_FAILED")
    for pattern, to in _PATHS:
        found = pattern.sub(to, found)
    return found


def _refused(_: str) -> None:
    raise Unfit("MALFORMED_JSON")  # NaN and infinities are no JSON


def sanitized(value: str, most_depth: int = MOST_DEPTH, most_nodes: int = MOST_NODES, most_bytes: int = MOST_BYTES) -> tuple[str | None, str | None]:
    """(canonical JSON, fault): keys sorted, no white space, whole numbers without a fraction; a value with a fault is not shown."""
    nodes = 0

    def visit(part, depth: int):
        nonlocal nodes
        nodes += 1
        if depth > most_depth:
            raise Unfit("TOO_DEEP")
        if nodes > most_nodes:
            raise Unfit("TOO_MANY_NODES")
        if isinstance(part, str):
            return clean_text(part)
        if isinstance(part, list):
            return [visit(p, depth + 1) for p in part]
        if isinstance(part, dict):
            made = {}
            for key, child in part.items():
                key = clean_text(key)
                if key in made:
                    raise Unfit("KEY_COLLISION")
                made[key] = visit(child, depth + 1)
            return made
        if isinstance(part, float) and part.is_integer() and abs(part) < 1e15:
            return int(part)
        return part

    try:
        made = json.dumps(visit(json.loads(value, parse_constant=_refused), 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except Unfit as e:
        return None, str(e)
    except RecursionError:
        return None, "TOO_DEEP"
    except ValueError:
        return None, "MALFORMED_JSON"
    made = made.encode("utf-8", "replace")  # half of a pair of surrogates has no UTF-8
    return (None, "TOO_LARGE") if len(made) > most_bytes else (made.decode(), None)


def sanitize_json(value: Column, most_depth: int = MOST_DEPTH, most_nodes: int = MOST_NODES, most_bytes: int = MOST_BYTES) -> Column:
    """Struct (json, fault) of a JSON text; null stays null without a fault."""

    @F.pandas_udf("json string, fault string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = [(None, None) if v is None else sanitized(v, most_depth, most_nodes, most_bytes) for v in values]
            yield pd.DataFrame({"json": pd.Series([r[0] for r in rows], dtype=object), "fault": pd.Series([r[1] for r in rows], dtype=object)})

    return run(value)
