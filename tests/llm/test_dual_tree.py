from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import dual_tree
from tidemark.llm.dual_tree import assign, cover_tree, whole_numbers

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, clusters=16, rounds=3, scale=64):
    """The contract's rules in Python's whole numbers: {row: (cluster, distance)}, centroids."""
    ints = [[math.floor(scale * x) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    centroids = [ints[i] for i in order[:clusters]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        mine = [nearest(v)[0] for v in ints]
        for k in range(len(centroids)):
            own = [v for v, m in zip(ints, mine) if m == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own)]
    return [nearest(v) for v in ints], centroids


def agrees(spark, rows, odd=(), **how):
    docs = spark.createDataFrame([*rows, *odd], SCHEMA).withColumns({"cluster": F.lit("clash"), "x": F.lit(3), "distance": F.lit(None)}).repartition(3)
    found = dual_tree.cluster(docs, dimensions=len(rows[0][1]), **how).collect()
    want, centroids = plain(rows, **{k: v for k, v in how.items() if k in ("clusters", "rounds", "scale")})
    long = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = [sum(d for c, d in want if c == k) for k in range(len(centroids))]
    lost = any(d >= 1 << 63 for _, d in want)
    key = lambda r: tuple(str(v) for v in r)
    got = [(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found]
    assert sorted(got, key=key) == sorted(((i, c, long(d), digests[c]) for (i, _), (c, d) in zip(rows, want)), key=key)
    for r in found:
        own = [d for c, d in want if c == r.cluster]
        assert r.cluster_inertia == (None if any(d >= 1 << 63 for d in own) else long(sums[r.cluster]))
        assert r.inertia == (None if lost else long(sum(sums)))
    return found


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "line"])
def test_trees_give_the_plain_assignment(kind):
    rng = np.random.default_rng(5)
    x = {
        "spread": rng.integers(-90, 90, (700, 12)),
        "clustered": rng.integers(-900, 900, (9, 12))[rng.integers(0, 9, 700)] + rng.integers(-5, 6, (700, 12)),
        "equal": np.repeat(rng.integers(-90, 90, (3, 12)), [400, 250, 50], axis=0),
        "line": np.arange(700)[:, None] * np.ones((1, 12), int),
    }[kind].astype(float)
    tree = cover_tree(x, 6)
    leaves = tree.last == tree.first
    assert sorted(tree.order) == list(range(len(x)))
    for i in np.flatnonzero(~leaves):
        children = np.arange(tree.first[i], tree.last[i])
        assert tree.begin[children[0]] == tree.begin[i] and tree.end[children[-1]] == tree.end[i]
        assert tree.point[children[0]] == tree.point[i]
        centres = x[tree.point[children]]
        gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(-1)) + np.eye(len(children)) * 1e9
        assert tree.radius[children].max() < gaps.min()  # separated by more than what each covers
    tree.point = np.argsort(tree.order)[tree.point]
    x = x[tree.order]
    for i in range(len(tree.point)):
        d = np.sqrt(((x[tree.begin[i] : tree.end[i]] - x[tree.point[i]]) ** 2).sum(1))
        assert d.max() <= tree.radius[i] + 1e-9
    tree.order = np.arange(len(x))
    c = np.concatenate([x[::60], x[:2]])  # equal centroids: ties to smaller numbers
    found = assign(x, tree, c, cover_tree(c, 1))
    mine = np.full(len(x), -1)
    for node, k in zip(found.nodes, found.node_clusters):
        assert (mine[tree.begin[node] : tree.end[node]] == -1).all()
        mine[tree.begin[node] : tree.end[node]] = k
    assert (mine[found.rows] == -1).all()
    mine[found.rows] = found.row_clusters
    want = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
    assert (mine == want).all()
    if kind == "clustered":  # whole nodes go without a look at their vectors
        assert found.compared < 0.2 * len(x) * len(c)


def test_clusters_agree_with_plain_rules(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) / (9 if i % 2 else 1)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])] * 5 + [(8, rows[9][1]), (None, rows[3][1]), (1000, [0.0] * 8), (1001, [-1 / 64] * 8)]
    rows += [(2000 + i, rows[11][1]) for i in range(150)]  # a third of all rows are one vector
    odd = [(5000, None), (5001, []), (5002, [1.0] * 7), (5003, [None] * 8), (5004, [float("nan")] * 8), (5005, [float("inf")] * 8), (5006, [1e300] * 8)]
    agrees(spark, rows, odd)
    agrees(spark, rows[:5], odd)
    agrees(spark, rows[:40], clusters=3, rounds=0)
    agrees(spark, [(i, [2.0, 3.0]) for i in range(40)])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    wide = [(i, [float(v) * 10.0 ** (i % 4) for v in rng.normal(size=4) * 1e4]) for i in range(60)]
    agrees(spark, wide)
    huge = [(i, [float(v) * (1e30 if i % 3 == 0 else 1.0) for v in rng.normal(size=4)]) for i in range(60)]
    found = agrees(spark, huge, clusters=4)
    assert any(r.distance is None for r in found)


def test_empty_tables(spark):
    found = dual_tree.cluster(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert dual_tree.cluster(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)).collect() == []
    assert whole_numbers(np.zeros((0, 4))).shape == (0, 4)
