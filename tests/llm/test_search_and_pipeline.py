from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from tidemark.llm import graph_ann, toxicity


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_search_of_parts_that_are_all_visited_is_exact(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "RECALL", 1.0)
    monkeypatch.setattr(graph_ann, "visits_for", lambda ways, true, recall: ways.shape[1])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]  # equal vectors: ties to smaller ids
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1100, [0.0] * 8, 1), (1200, [float("nan")] * 8, 1), (1300, [None] * 8, 1), (1400, [1.0] * 5, 1), (1500, [float("inf")] * 8, 1)]
    found = graph_ann.search(table(spark, rows + odd)).collect()
    ids = np.arange(400)
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by_query) == [0, 100, 200, 300]
    for q, got in by_query.items():
        want = plain_nearest(ids, x.astype(float), q, 10)
        assert [v for v, _ in got] == [v for v, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-12)
    assert graph_ann.search(table(spark, odd)).collect() == []
    few = graph_ann.search(table(spark, rows[:4])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(i + 1, v) for i, (v, _) in enumerate(plain_nearest(ids[:4], x[:4].astype(float), 0, 10))]


def test_a_repeated_query_row_asks_once_and_routing_is_used_at_every_size(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 4
    x = (centres[np.arange(500) % 12] + rng.normal(size=(500, 8)) / 4).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    lost = [(None, x[0].tolist(), 1)]
    docs = table(spark, rows + [rows[100]] + [rows[7]] * 2 + lost).withColumns({"part": F.lit("clash"), "v": F.lit(1), "visit": F.lit(2)})
    got = {}
    for r in sorted(graph_ann.search(docs).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids = np.array([*range(500), 100, 7, 7])
    wide = np.concatenate([x, x[[100, 7, 7]]]).astype(float)
    assert sorted(got) == [0, 100, 200, 300, 400] and all(len(v) == 10 for v in got.values())
    hits = [len(set(got[q]) & {v for v, _ in plain_nearest(ids, wide, q, 10)}) / len({v for v, _ in plain_nearest(ids, wide, q, 10)}) for q in got]
    assert np.mean(hits) >= 0.9


def test_queries_that_find_too_few_ask_all_parts(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "visits_for", lambda ways, true, recall: 1)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 4)).astype(np.float32)
    found = graph_ann.search(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), k=60).collect()
    ids = np.arange(160)
    got = {q: [(r.vec_id, r["rank"]) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    for q, own in got.items():
        assert own == [(v, i + 1) for i, (v, _) in enumerate(plain_nearest(ids, x.astype(float), q, 60))]


def test_search_recall_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "PART_ROWS", 250)
    monkeypatch.setattr(graph_ann, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 2
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    x[1000:2300] = x[1000]  # a third of all rows are one vector
    found = graph_ann.search(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), sample=1500).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(4000)
    hits = [len(got[q] & {v for v, _ in plain_nearest(ids, x.astype(float), q, 10)}) for q in range(0, 4000, 100)]
    assert len(got) == 40 and all(len(v) == 10 for v in got.values())
    assert sum(hits) / 400 >= 0.9


def test_pipeline_against_plain_rules(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    passage = ". ".join(words(rng, 12).capitalize() for _ in range(5)) + "."
    texts, toxic = [], {}
    for i in range(240):
        body = ". ".join(words(rng, 10).capitalize() for _ in range(5)) + "."
        if i % 4 == 0:
            body = body.replace(". ", ". vexator vexing vexous ")
            toxic[i] = 1
        elif rng.random() < 0.8:
            toxic[i] = 0
        texts.append(body)
    texts[11] = texts[13] = texts[17]
    texts[21] += "\n" + passage
    texts[23] += "\n" + passage
    texts += [None, ""]
    docs = documents(spark, texts, [rng.choice("abc") for _ in texts])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        seen[name] = kept.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    held = [i for i in range(0, 240, 4) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(ids["toxicity"] & set(held)) <= len(held) // 10
    assert len(ids["toxicity"]) >= 175 and {240, 241} <= ids["toxicity"]
    assert ids["ngram_jaccard_join"] & {11, 13, 17} == {11}
    assert len(ids["ngram_jaccard_join"]) == len(ids["toxicity"]) - 2
    cut = {r.doc_id: r for r in seen["substring_dedup"]}
    assert passage in cut[21].text and cut[23].text == texts[23].split("\n")[0] and cut[23].n_chars == len(cut[23].text)
    assert {r.doc_id for r in seen["mixing"]} <= ids["substring_dedup"]
    total = sum(len((r.text or "").split()) for r in seen["substring_dedup"])
    taken = sum(len((r.text or "").split()) for r in seen["mixing"])
    assert taken == pytest.approx(1.5 * total, rel=0.01)
    pieces = seen["best_fit_packing"]
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen["mixing"]}
    assert sum(1 for r in pieces if r.piece == 0) == len(seen["mixing"])
    assert math.isfinite(toxicity.THRESHOLD)
