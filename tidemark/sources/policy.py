"""Which files may be read as sources, and finding them."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names never read, and the shapes of sources below a home; fixed values.
FORBIDDEN = ("auth.json", "config.toml", ".env", "credentials.json")
SHAPE = r"^(?:history\.jsonl|session_index\.jsonl|sessions/(?:[^/]+/)*rollout-[^/]*\.jsonl)$"
MOST_ENTRIES, MOST_DEPTH = 100_000, 8


def refusal(home: Column, path: Column, excluded_roots: list[str] = ()) -> Column:
    """Why a path is no source, or null: the first reason of a fixed order."""
    name = F.element_at(F.split(path, "/"), -1)
    inside = path.startswith(F.concat(home, F.lit("/")))
    below = F.substring(path, F.length(home) + 2, 1 << 20)
    excluded = F.lit(False)
    for root in excluded_roots:
        excluded |= (path == root) | path.startswith(root.rstrip("/") + "/")
    return (
        F.when(name.isin(*FORBIDDEN), "forbidden_name")
        .when(excluded, "excluded_root")
        .when(~inside, "outside_home")
        .when(~below.rlike(SHAPE), "unknown_shape")
    )


@dataclass(frozen=True)
class SourceRef:
    path: str
    kind: str
    device: int
    inode: int
    size: int
    modified_at: float


def discover(homes: list[str]) -> list[SourceRef]:
    """Sources below homes, sorted by path: bounded depth and entries, no symbolic links."""
    found, entries = [], 0
    for home in homes:
        stack = [(home, 0)]
        while stack:
            folder, depth = stack.pop()
            if not os.path.isdir(folder):
                continue
            for e in os.scandir(folder):
                entries += 1
                if entries > MOST_ENTRIES:
                    raise ValueError("too many entries below a home")
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if depth < MOST_DEPTH and (depth or e.name == "sessions"):
                        stack.append((e.path, depth + 1))
                    continue
                below = os.path.relpath(e.path, home)
                rollout = below.startswith("sessions/") and e.name.startswith("rollout-") and e.name.endswith(".jsonl")
                if rollout or below in ("history.jsonl", "session_index.jsonl"):
                    s = e.stat()
                    kind = "rollout" if rollout else below.removesuffix(".jsonl")
                    found.append(SourceRef(e.path, kind, s.st_dev, s.st_ino, s.st_size, s.st_mtime * 1000))
    return sorted(found, key=lambda r: r.path)
