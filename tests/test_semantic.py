from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import semantic
from tidemark.operators.semantic import Found, VectorTable, retrieve
from tidemark.sources import workspace

WORDS = ("red", "blue", "green")
MANIFEST = {"provider": "test", "model": "counts", "revision": "1", "dimensions": len(WORDS) + 1, "metric": "l2", "normalization": "none"}


class Counts:
    """Embeds a text as its words' counts."""

    def __init__(self, said="ready", manifest=MANIFEST, fails=False):
        self.said, self.told, self.fails = said, manifest, fails

    def capability(self):
        if self.fails:
            raise RuntimeError("secret detail")
        return self.said, None

    def manifest(self):
        return self.told

    def embed(self, texts):
        words = WORDS

        @F.pandas_udf("array<double>")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda t: [float((t or "").split().count(w)) for w in words] + [1.0])

        return run(texts)


@pytest.fixture(scope="module")
def stored(spark):
    said = ["red", "red red", "blue", "blue green", "green", "red blue", "red"]
    rows = [(f"e{i}", "decision" if i % 2 else "chunk", "", t, f"f{i}", "p" if i < 5 else "q", None, f"s{i % 2}", f"2024-0{i + 1}") for i, t in enumerate(said)]
    content = spark.createDataFrame(rows, "entity_id string, type string, title string, body string, fingerprint string, project_id string, workstream_id string, session_id string, observed_at string")
    table = VectorTable(spark, workspace.new_folder(spark, "test-vectors"))
    table.write(semantic.embedded(content, Counts(), "space"), MANIFEST["dimensions"])
    spaces = spark.createDataFrame([tuple({"space_id": "space", "status": "active", **MANIFEST}.values())], "space_id string, status string, provider string, model string, revision string, dimensions int, metric string, normalization string")
    return table, spaces


def test_searches_are_narrowed_before_they_are_ranked(stored):
    table, spaces = stored
    ask = lambda boundary, **how: [(r.entity_id, r["rank"], r.fingerprint) for r in sorted(retrieve("red", Counts(), spaces, table, boundary, **how).candidates.collect(), key=lambda r: r["rank"])]
    assert ask({"project_id": "p"}, limit=2) == [("e0", 1, "f0"), ("e1", 2, "f1")]
    assert ask({"project_id": "q"}) == [("e6", 1, "f6"), ("e5", 2, "f5")]
    assert ask({"project_id": "p"}, types=["decision"]) == [("e1", 1, "f1"), ("e3", 2, "f3")]
    assert ask({"project_id": "p", "session_id": "s1"}, start="2024-04") == [("e3", 1, "f3")]
    assert ask({"project_id": "p"}, end="2024-01") == [("e0", 1, "f0")] and ask({"project_id": "none"}) == []


def test_what_is_missing_or_fails_is_a_state(stored, spark):
    table, spaces = stored
    state = lambda provider, s=spaces, t=table, **how: retrieve("red", provider, s, t, {"project_id": "p"}, **how).state
    assert state(None) == state(Counts(), None) == state(Counts(), spaces, None) == state(Counts("disabled")) == "disabled"
    assert state(Counts(), paths=["a/b"]) == state(Counts(), branch="main") == "not_applicable"
    assert state(Counts("loading")) == state(Counts("not_downloaded")) == state(Counts(), spaces.withColumn("status", F.lit("retired"))) == "indexing"
    assert state(Counts("failed")) == state(Counts(manifest=MANIFEST | {"model": "other"})) == "unavailable"
    assert state(Counts(), spaces.withColumn("dimensions", F.lit(9)), table) == "unavailable"
    assert retrieve("red", Counts(fails=True), spaces, table, {"project_id": "p"}) == Found("unavailable", "RuntimeError")
    assert retrieve("red", Counts(), spaces, VectorTable(spark, "/nowhere"), {"project_id": "p"}).state == "unavailable"
    with pytest.raises(ValueError):
        table.write(spark.createDataFrame([("x", "space", [1.0], "p")], "vector_id string, space_id string, v array<double>, project_id string"), 4)
    with pytest.raises(ValueError):
        semantic.nearest(spaces, spaces, "manhattan", 3)


def test_nearest_against_plain_distances_with_scopes_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK_ROWS", 20)
    rows = [(f"v{i:03d}", [float(i % 7), float(i % 5)], "a" if i % 3 else None) for i in range(120)]
    odd = [("w0", None, "a"), ("w1", [], "a"), ("w2", [None, 1.0], "a"), ("w3", [1.0, 2.0, 3.0], "a")]
    vectors = spark.createDataFrame([*rows, *odd], "vec_id string, v array<double>, project string")
    queries = spark.createDataFrame([(n, [1.0, float(n)], p) for n in range(6) for p in ("a", None)][:9], "query_id long, q array<double>, project string").dropDuplicates(["query_id"])
    for metric in semantic.METRICS:
        asked = queries.collect()
        found = semantic.nearest(vectors, queries, metric, 4, ["project"]).collect()
        for a in asked:
            import numpy as np

            def far(v, a=a, metric=metric):
                x, q = np.array(v), np.array(a.q)
                return float(np.sqrt(((x - q) ** 2).sum())) if metric == "l2" else -float(x @ q) if metric == "dot" else 1 - float(x @ q) / float(np.linalg.norm(x) * np.linalg.norm(q)) if x.any() else float("inf")

            want = sorted((round(far(v), 9), i) for i, v, p in rows if p == a.project)[:4]
            got = sorted((round(r.distance, 9), r.vec_id) for r in found if r.query_id == a.query_id)
            assert [d for d, _ in got] == pytest.approx([d for d, _ in want], abs=1e-8)
    assert semantic.nearest(vectors.limit(0), queries, "l2", 3).collect() == []


def test_an_engine_fuses_both_branches(spark):
    from tests.test_engine import tables
    from tidemark.plans import engine

    t = tables(spark)
    t.spaces = spark.createDataFrame([tuple({"space_id": "space", "status": "active", **MANIFEST}.values())], "space_id string, status string, provider string, model string, revision string, dimensions int, metric string, normalization string")
    e = engine.Engine(spark, t, provider=Counts())
    e.index(20, 40)
    e.embed("space")
    found = e.search("red cache things", {"project_id": "p"})  # no text holds all three words
    assert found.extra["semantic"] == "ready" and found.items and all("red" in i["snippet"] for i in found.items[:2])
    assert e.search("red cache", {"project_id": "p"}, branch="main").extra["semantic"] == "not_applicable"
