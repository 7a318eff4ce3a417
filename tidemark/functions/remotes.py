"""Network addresses of repositories in one canonical spelling, without credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose paths ignore case; fixed values.
CASELESS_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "dev.azure.com")
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/@\s]*)@)?([^/:?#\s]*)(?::(\d+))?([^?#]*)(.*)$"
SCP = r"^(?:([^@\s/:]+)@)?([^\s/:]+):(.+)$"


def _path(raw: Column, host: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), r"^/+|/+$", ""), r"/{2,}", "/")
    flat = F.regexp_replace(flat, r"(?i)\.git$", "")
    bad = (F.length(flat) == 0) | (F.length(flat) > 3072) | flat.rlike(r"(^|/)\.{0,2}(/|$)") | flat.rlike(r"[\x00-\x1f\x7f?#]")
    return F.when(~bad, F.when(F.lower(host).isin(*CASELESS_HOSTS), F.lower(flat)).otherwise(flat))


def normalize_remote(raw: Column) -> Column:
    """Struct (canonical, host, repository_path, transport, credentials_stripped, reason): reason is null where it worked."""
    value = F.trim(raw)
    is_url = value.contains("://")
    part = lambda i: F.regexp_extract(value, URL, i)
    scheme, user, name, port, rest = F.lower(part(1)), part(2), F.lower(part(3)), part(4), part(6)
    usual = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    url_host = F.when((port == "") | (port == usual), name).otherwise(F.concat(name, F.lit(":"), port))
    scp_host = F.lower(F.regexp_extract(value, SCP, 2))
    scp_user = F.regexp_extract(value, SCP, 1)
    host = F.when(is_url, url_host).otherwise(scp_host)
    path = F.when(is_url, _path(part(5), name)).otherwise(_path(F.regexp_extract(value, SCP, 3), scp_host))
    local = value.rlike(r"^(/|\./|\.\./|~/|[A-Za-z]:[\\/]|\\\\)")
    reason = (
        F.when(raw.isNull() | (value == ""), "empty")
        .when(F.length(value) > 4096, "too_long")
        .when(value.rlike(r"[\x00-\x1f\x7f]"), "control_character")
        .when(local, "local_path")
        .when(~is_url & ~value.rlike(SCP), "invalid")
        .when(is_url & ~value.rlike(URL), "invalid")
        .when(is_url & ~scheme.isin("https", "http", "ssh", "git"), "unsupported_protocol")
        .when(is_url & (F.length(rest) > 1), "query_or_fragment")
        .when(is_url & (name == ""), "missing_host")
        .when(path.isNull(), "missing_repository_path")
    )
    good = reason.isNull()
    return F.struct(
        F.when(good, F.concat(host, F.lit("/"), path)).alias("canonical"),
        F.when(good, host).alias("host"),
        F.when(good, path).alias("repository_path"),
        F.when(good, F.when(is_url, scheme).otherwise("scp")).alias("transport"),
        F.when(good, F.when(is_url, user != "").otherwise((scp_user != "") & (scp_user != "git"))).alias("credentials_stripped"),
        reason.alias("reason"),
    )
