"""Ignore rules: gitignore-like globs compiled to one expression, the last rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IgnoreRule:
    line: int
    pattern: str
    include: bool

    @property
    def regex(self) -> str:
        return glob_regex(self.pattern)


def glob_regex(glob: str) -> str:
    """`**` crosses slashes, `*` and `?` do not; a rule with an inner slash is anchored, a final slash means a folder."""
    folder, glob = glob.endswith("/"), glob.strip("/") if glob != "/" else glob
    anchored = "/" in glob
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])))
            i += 1
    return ("^/?" if anchored else "^(?:.*/)?") + "".join(out) + ("/.*$" if folder else "(?:/.*)?$")


def parse_rules(source: str) -> list[IgnoreRule]:
    rules = []
    for no, raw in enumerate(source.splitlines(), 1):
        line = raw.strip()
        if line and not line.startswith("#"):
            rules.append(IgnoreRule(no, line.removeprefix("!"), line.startswith("!")))
    return rules


def excluded(path: Column, rules: list[IgnoreRule], selected: Column | None = None) -> Column:
    """Whether a path is left out; an explicit selection comes first."""
    found = F.lit(False)
    for rule in rules:  # a later rule wraps, and so overrules, the earlier ones
        found = F.when(path.rlike(rule.regex), F.lit(not rule.include)).otherwise(found)
    return F.when(selected, F.lit(False)).otherwise(found) if selected is not None else found
