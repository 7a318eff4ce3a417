"""Stable identities as Column builders: length-prefixed parts under a namespaced SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of every identity; a fixed value (the second colon belongs to it).
PREFIX = "ku::"


def encode_parts(*parts: Column) -> Column:
    """Each part with its UTF-8 length in front, joined by bars; null if any part is null."""
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    joined = sized[0]
    for p in sized[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return joined


def encode_array(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)), "|")


def nul() -> Column:
    return F.decode(F.unhex(F.lit("00")), "UTF-8")


def stable_id(namespace: str, *parts: Column) -> Column:
    return _hashed(namespace, encode_parts(*parts))


def stable_id_of_array(namespace: str, parts: Column) -> Column:
    return _hashed(namespace, encode_array(parts))


def _hashed(namespace: str, encoded: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(namespace), nul(), encoded), 256)
    return F.concat(F.lit(f"{PREFIX}{namespace}:"), digest)


def is_stable_id(value: Column, namespace: str) -> Column:
    return F.coalesce(value.rlike(f"^{PREFIX}{namespace}:[0-9a-f]{{64}}$"), F.lit(False))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def stable_id_py(namespace: str, *parts: str) -> str:
    """The same identity on the driver; empty lists of parts are refused."""
    if not parts:
        raise ValueError("an identity needs a part")
    encoded = "|".join(f"{len(p.encode())}:{p}" for p in parts)
    return f"{PREFIX}{namespace}:{hashlib.sha256(f'{namespace}\0{encoded}'.encode()).hexdigest()}"
