"""The registry of sources and its cursors on small planted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import registry

SEEN = "path string, kind string, device long, inode long, size long, modified_at double"
KNOWN = SEEN + ", committed_offset long, first_seen_at long, last_seen_at long"
CURSORS = "source_id string, fingerprint string, committed_offset long, line_hash string, written_at long"


def fold(spark, known, seen):
    rows = registry.fold(spark.createDataFrame(known, KNOWN), spark.createDataFrame(seen, SEEN), F.lit(2).cast("long")).collect()
    return {r["path"]: (r["change"], r["size"], r["committed_offset"], r["first_seen_at"], r["last_seen_at"], r["moved_from"]) for r in rows}


def test_changes_and_places(spark):
    known = [
        ("same", "r", 1, 1, 10, 0.0, 9, 1, 1),
        ("grown", "r", 1, 2, 10, 0.0, 9, 1, 1),
        ("cut", "r", 1, 3, 10, 0.0, 9, 1, 1),
        ("swapped", "r", 1, 4, 10, 0.0, 9, 1, 1),
        ("touched", "r", 1, 5, 10, 0.0, 9, 1, 1),
        ("old", "r", 1, 6, 10, 0.0, 9, 1, 1),
        ("lost", "r", 1, 7, 10, 0.0, 9, 1, 1),
        ("broken", "r", 1, 8, 10, 0.0, 9, 1, 1),
        ("nameless", "r", None, None, 10, 0.0, 9, 1, 1),
    ]
    seen = [
        ("same", "r", 1, 1, 10, 0.0),
        ("grown", "r", 1, 2, 12, 1.0),
        ("cut", "r", 1, 3, 4, 1.0),
        ("swapped", "r", 1, 40, 10, 0.0),
        ("touched", "r", 1, 5, 10, 1.0),
        ("renamed", "r", 1, 6, 11, 1.0),
        ("broken", "r", 1, 8, -1, 0.0),
        ("nameless", "r", None, None, 11, 0.0),
        ("fresh", "r", 1, 9, 3, 0.0),
        ("fresh", "r", 1, 9, 5, 1.0),
        ("", "r", 1, 10, 3, 0.0),
        (None, "r", 1, 11, 3, 0.0),
        ("never", "r", 1, 12, None, 0.0),
    ]
    assert fold(spark, known, seen) == {
        "same": ("unchanged", 10, 9, 1, 2, None),
        "grown": ("appended", 12, 9, 1, 2, None),
        "cut": ("truncated", 4, 0, 1, 2, None),
        "swapped": ("rotated", 10, 0, 2, 2, None),
        "touched": ("touched", 10, 9, 1, 2, None),
        "renamed": ("moved", 11, 9, 1, 2, "old"),
        "lost": ("missing", 10, 9, 1, 1, None),
        "broken": ("faulty", 10, 9, 1, 1, None),
        "nameless": ("appended", 11, 9, 1, 2, None),
        "fresh": ("new", 5, 0, 2, 2, None),
    }


def test_empty_tables(spark):
    one = ("a", "r", 1, 1, 10, 0.0)
    assert fold(spark, [], []) == {}
    assert fold(spark, [], [one]) == {"a": ("new", 10, 0, 2, 2, None)}
    assert fold(spark, [(*one, 9, 1, 1)], []) == {"a": ("missing", 10, 9, 1, 1, None)}


def test_cursors_go_forward_only(spark):
    cursors = spark.createDataFrame([("a", "x", 10, "h", 1), ("b", "x", 10, "h", 1), ("c", "x", 10, None, 1)], CURSORS)
    proposals = spark.createDataFrame([("a", "x", 5, "i", 2), ("b", "y", 5, "i", 2), ("d", "x", 1, "i", 2), ("d", "x", 3, "j", 2), ("d", "x", 9, "k", 1)], CURSORS)

    def told(**how):
        return {r["source_id"]: (r["committed_offset"], r["line_hash"], r["outcome"]) for r in registry.advance(cursors, proposals, **how).collect()}

    forward = {"a": (10, "h", "refused"), "b": (5, "i", "written"), "c": (10, None, "kept"), "d": (3, "j", "written")}
    assert told() == forward
    assert told(allow_backward=True) == forward | {"a": (5, "i", "written")}
