"""What users and sources type, made plain: aliases, search queries, git metadata, titles and addresses.

A value that is not allowed becomes null; lengths are code points.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text

ALIAS_MOST = 256
QUERY_MOST = 2048
#: Schemes that a repository's address may have; fixed values.
REPOSITORY_SCHEMES = ("https", "http", "ssh", "git")


def _bounded(value: Column, most: int) -> Column:
    return F.when(F.length(value).between(1, most), value)


def alias(value: Column) -> Column:
    """A scope's alias: no control characters, normal form, single spaces, lower case, 1 to 256 characters."""
    clean = F.lower(text.single_spaced(text.nfkc(value)))
    return F.when(~value.rlike(r"[\x00-\x1f\x7f]"), _bounded(clean, ALIAS_MOST))


def search_query(value: Column) -> Column:
    """A search query: no control characters but tabs and line ends, normal form, single spaces, 1 to 2048 characters."""
    clean = text.single_spaced(text.nfkc(value))
    return F.when(~value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), _bounded(clean, QUERY_MOST))


def plain_query(value: str) -> str:
    """search_query on the driver: the plain query, or ValueError for one that is not allowed."""
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", value):
        raise ValueError("a search query holds no control characters")
    clean = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value).strip())
    if not 1 <= len(clean) <= QUERY_MOST:
        raise ValueError(f"a search query has from 1 to {QUERY_MOST} characters")
    return clean


def commit_hash(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9a-fA-F]{7,64}$"), F.lower(value))


def repository_url(value: Column) -> Column:
    """A repository's address without user and password; null with a query, a fragment or another scheme."""
    given = _bounded(value, 4096)
    short = F.when(~given.contains("://"), given)
    host, path = (F.regexp_extract(short, r"^(?:[^@\s/:]+@)?([^\s/:]+):([^\s]+)$", i) for i in (1, 2))
    scheme, rest = (F.regexp_extract(given, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^@/?#\s]*@)?([^/?#\s@][^?#\s]*)$", i) for i in (1, 2))
    whole_host = F.lower(F.regexp_extract(rest, r"^[^/]+", 0))
    tail = F.substring(rest, F.length(whole_host) + 1, F.length(rest))
    web = F.when((tail == "") & F.lower(scheme).isin("https", "http"), F.lit("/")).otherwise(tail)
    url = F.concat(F.lower(scheme), F.lit("://"), whole_host, web)
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.lower(host), F.lit(":"), path)).when(F.lower(scheme).isin(*REPOSITORY_SCHEMES), url)


def session_title(title: Column, last_activity: Column, started: Column, branch: Column) -> Column:
    """A session's own title, or one of its day and branch."""
    day = F.coalesce(F.substring(last_activity, 1, 10), F.substring(started, 1, 10))
    return F.when(F.length(F.trim(title)) > 0, title).otherwise(F.concat_ws(" · ", F.lit("Codex session"), day, branch))


#: Scheme of the addresses under which sessions are found.
SESSION_SCHEME = "tidemark"


def session_uri(session_id: Column, scheme: str = SESSION_SCHEME) -> Column:
    # The form encoding writes a space as +, an address as %20.
    return F.concat(F.lit(f"{scheme}://sessions/"), F.replace(F.url_encode(session_id.cast("string")), F.lit("+"), F.lit("%20")))


def scope_address(kind: Column, scope_id: Column, project_id: Column, workstream_id: Column) -> Column:
    """(project_id, workstream_id, session_id) of a scope of any kind."""
    return F.struct(
        F.when(kind == "project", scope_id).otherwise(project_id).alias("project_id"),
        F.when(kind == "workstream", scope_id).when(kind == "session", workstream_id).alias("workstream_id"),
        F.when(kind == "session", scope_id).alias("session_id"),
    )


def scope_name(kind: Column, scope_id: Column, display_name: Column) -> Column:
    return F.when(kind == "session", F.coalesce(display_name, scope_id)).otherwise(display_name)
