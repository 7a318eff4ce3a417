"""Lloyd's clustering with two trees: a cover tree over vectors and one over centroids each round.

Vectors become whole numbers, floor(scale * component). Every BLOCK_ROWS of a task's vectors make one
cover tree, built once and stored in the shared folder: rows in tree order, so that a node's vectors are
one range, and for each node its vector, its children and the greatest distance to a vector below it.
A round sends the centroids (k of them) to all blocks. There the pairs of a vector node and a centroid
node are followed downwards together, whole levels at a time: a centroid node whose nearest possible
distance is beyond the farthest possible distance of a vector node's best centroid goes; a node with one
centroid left is assigned as a whole, and gives its count and its vectors' sum without a look at them;
leaves that keep several centroids are compared exactly. Blocks give sums by cluster, which Spark adds.

All decisions are exact: squared distances and sums are whole numbers in doubles while those hold them,
and Python's whole numbers beyond. Bounds carry a slack above the rounding of their roots. Nothing is
shuffled but a task's sums; the driver holds k centroids.

Defined results: vectors that are null, of another length, or hold null or non-finite components (or ones
of 2^500 on, whose squares have no double) take no part; equal distances go to the smaller cluster; rows that repeat a vec_id or a vector count each; with
fewer vectors than k there are as many clusters as vectors; a null vec_id is kept and comes last as a
first centroid; a distance or a sum of distances above the range of a long is null; an empty table gives
an empty table; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, scratched, tidy

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
#: Vectors of a tree: a block is a few megabytes.
BLOCK_ROWS = 2_048
LEAF_ROWS = 12
LEAF_CENTROIDS = 1
HUGE = float(1 << 500)
#: Sums travel in whole numbers of this many bits, each with the sum's sign; those that are 0 stay behind.
LIMB_BITS, LIMBS = 40, 14
_LONG = (1 << 63) - 1


def doubles_hold(largest: float, dimensions: int) -> bool:
    """Whether doubles hold squared distances of vectors with components up to `largest` exactly."""
    return largest <= math.isqrt((1 << 51) // max(1, dimensions))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """x, whose values are whole, as it is or with Python's numbers where doubles would round."""
    if x.dtype == object or not x.size or doubles_hold(np.abs(x).max(), x.shape[1]):
        return x
    return python_numbers(x)


def python_numbers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squares.astype(np.float64), 0.0))


def squared_to(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row to one vector."""
    d = x - one
    return (d * d).sum(axis=1)


@dataclass
class CoverTree:
    """Rows in tree order; node i holds rows begin[i]:end[i] below its vector, and children first[i]:last[i]."""

    order: np.ndarray
    point: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray


def cover_tree(x: np.ndarray, leaf_rows: int) -> CoverTree:
    """A cover tree of rows: children hold the rows within a scale of their vectors, which lie farther apart than that.

    A node's rows lie within twice the scale, the next power of 2 below the farthest of them, so levels at
    which nothing would part are passed over. Nodes are numbered level by level, so that a node's
    children are neighbours; a node of few rows, or of equal ones, is a leaf.
    """
    if x.dtype == object:
        between = lambda rows, one: roots(squared_to(x[rows], x[one]))
    else:
        squares = (x * x).sum(axis=1)
        table = roots(squares[:, None] + squares - 2 * x @ x.T)  # whole numbers before their roots
        between = lambda rows, one: table[one, rows]
    every = np.arange(len(x))
    point, sets, dists = [0], [every], [between(every, 0)]
    first, last = [], []
    at = 0
    while at < len(point):
        rows, d = sets[at], dists[at]
        first.append(len(point))
        farthest = float(d.max())
        if len(rows) > leaf_rows and farthest > 0:
            scale = 2.0 ** np.floor(np.log2(farthest))
            if scale >= farthest:
                scale /= 2
            # The node's own vector is the first child; then any row that no child has taken.
            centre, there = point[at], d
            while len(rows):
                near = there <= scale
                point.append(centre)
                sets.append(rows[near])
                dists.append(there[near])
                rows = rows[~near]
                if len(rows):
                    centre = int(rows[0])
                    there = between(rows, centre)
        last.append(len(point))
        at += 1
    # Leaves' rows in depth-first order: a node's range is its children's.
    n = len(point)
    sizes = np.array([len(s) for s in sets])
    begin = np.zeros(n, np.int64)
    for i in range(n):
        if last[i] > first[i]:
            own = sizes[first[i] : last[i]]
            begin[first[i] : last[i]] = begin[i] + np.cumsum(own) - own
    order = np.empty(len(x), np.int64)
    for i in range(n):
        if last[i] == first[i]:
            order[begin[i] : begin[i] + sizes[i]] = sets[i]
    radius = np.array([float(d.max()) for d in dists])
    return CoverTree(order, np.array(point), begin, begin + sizes, np.array(first), np.array(last), radius)


@dataclass
class Assigned:
    """Whole nodes with their cluster, and rows of leaves with theirs; `compared` counts exact comparisons."""

    nodes: np.ndarray
    node_clusters: np.ndarray
    rows: np.ndarray
    row_clusters: np.ndarray
    compared: int


def _children(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the given nodes, child) of all children of nodes with those ranges."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]


def assign(x: np.ndarray, tree: CoverTree, centroids: np.ndarray, centre_tree: CoverTree) -> Assigned:
    """The nearest centroid of each row of x, which lie in tree order, by pairs of nodes; ties to smaller numbers."""
    node_x, node_c = x[tree.point], centroids[centre_tree.point]
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    nodes, node_clusters, rows, row_clusters, compared = [], [], [], [], 0
    while len(q):
        # A vector node's pairs hold all centroids that can be nearest to a vector below it.
        d = node_x[q] - node_c[r]
        d = roots((d * d).sum(axis=1))
        # A centroid node's vector is a centroid: no vector below is farther from its best one than this.
        best = np.full(len(tree.point), np.inf)
        np.minimum.at(best, q, d)
        best += tree.radius
        least = d - tree.radius[q] - centre_tree.radius[r]
        keep = least <= best[q] * (1 + 1e-9) + 1e-9
        q, r = q[keep], r[keep]
        number = np.bincount(q, minlength=len(tree.point))
        single = (centre_tree.end - centre_tree.begin)[r] == 1
        done = single & (number[q] == 1)
        nodes.append(q[done])
        node_clusters.append(centre_tree.order[centre_tree.begin[r[done]]])
        q, r, single = q[~done], r[~done], single[~done]
        # The wider node of a pair goes on to its children, the other one where that has none.
        more_r = centre_tree.last[r] > centre_tree.first[r]
        leaf = tree.last[q] == tree.first[q]
        split_r = more_r & (leaf | (centre_tree.radius[r] >= tree.radius[q]))
        # A vector node's pairs go down together, so that its centroids stay in one place.
        waits = np.zeros(len(tree.point), bool)
        waits[q[split_r]] = True
        ready = leaf & ~waits[q]
        if ready.any():
            at, members = _leaf_pairs(q[ready], r[ready], tree, centre_tree)
            got, cost = compare(x, centroids, at, members, tree)
            rows.append(got[0])
            row_clusters.append(got[1])
            compared += cost
        go = ~ready
        q, r, split_r = q[go], r[go], split_r[go]
        owner, child_r = _children(centre_tree.first[r[split_r]], centre_tree.last[r[split_r]])
        parts = [(q[split_r][owner], child_r)]
        stay = ~split_r & waits[q]
        parts.append((q[stay], r[stay]))
        down = ~split_r & ~waits[q]
        owner, child_q = _children(tree.first[q[down]], tree.last[q[down]])
        parts.append((child_q, r[down][owner]))
        q, r = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Assigned(join(nodes), join(node_clusters), join(rows), join(row_clusters), compared)


def _leaf_pairs(q: np.ndarray, r: np.ndarray, tree: CoverTree, centre_tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, centroid) of pairs of nodes."""
    owner, place = _children(centre_tree.begin[r], centre_tree.end[r])
    return q[owner], centre_tree.order[place]


def compare(x: np.ndarray, centroids: np.ndarray, leaves: np.ndarray, members: np.ndarray, tree: CoverTree) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The nearest of each leaf's centroids for each of its rows, exactly."""
    met = np.unique(leaves)
    owner, rows = _children(tree.begin[met], tree.end[met])
    allowed = np.zeros((len(met), len(centroids)), bool)
    allowed[np.searchsorted(met, leaves), members] = True
    best = np.zeros(len(rows), np.int64)
    least = np.full(len(rows), None if x.dtype == object else np.inf, x.dtype)
    cost = 0
    for c in range(len(centroids)):  # in order, and only a smaller distance changes the choice: ties to smaller numbers
        asked = np.flatnonzero(allowed[owner, c])
        if not len(asked):
            continue
        cost += len(asked)
        d = squared_to(x[rows[asked]], centroids[c])
        old = least[asked]
        nearer = np.array([o is None or n < o for n, o in zip(d, old)], bool) if x.dtype == object else d < old
        least[asked[nearer]] = d[nearer]
        best[asked[nearer]] = c
    return (rows, best), cost


# ---------------------------------------------------------------- blocks of vectors

_BLOCK_DDL = (
    "ids array<long>, x array<double>, point array<long>, begin array<long>, end array<long>, "
    "first array<long>, last array<long>, radius array<double>"
)


def _blocks(dimensions: int):
    """A task's vectors as blocks of BLOCK_ROWS with their trees."""

    def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
        numbers = whole_numbers(x)
        tree = cover_tree(numbers, LEAF_ROWS)
        tree.point = np.argsort(tree.order)[tree.point]  # rows are stored in tree order
        columns = [
            pa.array([[ids[i] for i in tree.order]], pa.list_(pa.int64())),
            pa.array([x[tree.order].ravel()], pa.list_(pa.float64())),
            *(pa.array([getattr(tree, c)], pa.list_(pa.int64())) for c in ("point", "begin", "end", "first", "last")),
            pa.array([tree.radius], pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "x", "point", "begin", "end", "first", "last", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                one = batch.slice(start, BLOCK_ROWS)
                ids += one.column(0).to_pylist()
                parts.append(one.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                if len(ids) >= BLOCK_ROWS:
                    x = np.concatenate(parts)
                    yield block(ids[:BLOCK_ROWS], x[:BLOCK_ROWS])
                    ids, parts = ids[BLOCK_ROWS:], [x[BLOCK_ROWS:]]
        if ids:
            yield block(ids, np.concatenate(parts))

    return run


def _each_block(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray, CoverTree]]:
    """(ids, x as stored, x exact, tree) of each stored block."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda i: batch.column(i)[row].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            x = get(1).reshape(-1, dimensions)
            point, begin, end, first, last, radius = (get(i) for i in range(2, 8))
            tree = CoverTree(np.arange(len(x)), point, begin, end, first, last, radius)
            yield batch.column(0)[row].values, x, whole_numbers(x), tree


def limbs(values: list[int]) -> tuple[list[int], list[int]]:
    """(place, limb) of each limb of the values that is not 0."""
    places, found = [], []
    for i, value in enumerate(values):
        sign, rest, at = (-1 if value < 0 else 1), abs(value), i * LIMBS
        while rest:
            if low := rest & ((1 << LIMB_BITS) - 1):
                places.append(at)
                found.append(sign * low)
            rest >>= LIMB_BITS
            at += 1
    return places, found


def _sums(centroids: list[list[int]], dimensions: int):
    """By cluster, the count and the limbs of the componentwise sum of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        totals = [[0] * dimensions for _ in centroids]
        for _, x, numbers, tree in _each_block(batches, dimensions):
            c, numbers = together(centroids, numbers)
            found = assign(numbers, tree, c, cover_tree(c, LEAF_CENTROIDS))
            running = np.concatenate([np.zeros((1, dimensions), numbers.dtype), np.cumsum(numbers, axis=0)])
            by_node = running[tree.end[found.nodes]] - running[tree.begin[found.nodes]]
            for cluster in range(len(centroids)):
                whole, rows = found.node_clusters == cluster, found.rows[found.row_clusters == cluster]
                counts[cluster] += int((tree.end - tree.begin)[found.nodes[whole]].sum()) + len(rows)
                own = by_node[whole].sum(axis=0) + numbers[rows].sum(axis=0)
                totals[cluster] = [t + int(v) for t, v in zip(totals[cluster], own)]
        rows = [(k, n, *limbs(totals[k])) for k, n in enumerate(counts) if n]
        types = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["cluster", "n", "place", "limb"])

    return run


def together(centroids: list[list[int]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and vectors in one exact kind of number."""
    largest = max((abs(v) for c in centroids for v in c), default=0)
    if x.dtype == object or not doubles_hold(largest, x.shape[1]):
        return np.array(centroids, object), x if x.dtype == object else python_numbers(x)
    return np.array(centroids, np.float64), x


def _labels(centroids: list[list[int]], dimensions: int):
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, tree in _each_block(batches, dimensions):
            c, numbers = together(centroids, numbers)
            found = assign(numbers, tree, c, cover_tree(c, LEAF_CENTROIDS))
            cluster = np.empty(len(numbers), np.int64)
            owner, rows = _children(tree.begin[found.nodes], tree.end[found.nodes])
            cluster[rows] = found.node_clusters[owner]
            cluster[found.rows] = found.row_clusters
            d = numbers - c[cluster]
            d = [int(v) for v in (d * d).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(cluster, pa.int32()), pa.array([v if v <= _LONG else None for v in d], pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of vectors that take part, as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= HUGE / scale))
    # floor() would end at the range of a long.
    down = lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e)
    return vectors.filter((F.size("embedding") == dimensions) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda e: down(e * float(scale)) + 0.0).alias("x")
    )


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()
    return [[int(v) for v in r["x"]] for r in rows]


def moved(sums: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """The centroids after a round: each cluster's floor of the mean; an empty one stays."""
    counts = {r["cluster"]: r["n"] for r in sums.groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    each = sums.select("cluster", F.explode(F.arrays_zip("place", "limb")).alias("of"))
    added = each.groupBy("cluster", F.col("of.place").alias("place")).agg(F.sum("of.limb").alias("limb")).collect()
    totals = {k: [0] * dimensions for k in counts}
    for r in added:
        totals[r["cluster"]][r["place"] // LIMBS] += r["limb"] << (LIMB_BITS * (r["place"] % LIMBS))
    return [[t // counts[k] for t in totals[k]] if k in counts else c for k, c in enumerate(centroids)]


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


@scratched
def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions, scale)
    centroids = first_centroids(kept, clusters, seed)
    if not centroids:
        return kept.selectExpr(
            "vec_id", "cast(0 as int) as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256"
        ).filter("false")
    blocks = materialize(kept.mapInArrow(tidy(_blocks(dimensions)), _BLOCK_DDL), "vector-trees")
    for _ in range(rounds):
        sums = blocks.mapInArrow(tidy(_sums(centroids, dimensions)), "cluster int, n long, place array<int>, limb array<long>")
        centroids = moved(materialize(sums, "cluster-sums"), centroids, dimensions)
    found = materialize(blocks.mapInArrow(tidy(_labels(centroids, dimensions)), "vec_id long, cluster int, distance long"), "clustered")
    # One row a cluster: small by the number of clusters.
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = lambda total: F.when(total <= F.lit(_LONG), total).cast("long")
    lost = F.max(F.col("distance").isNull())
    each = found.groupBy("cluster").agg(exact.alias("s"), lost.alias("lost")).collect()
    total = None if any(r["lost"] for r in each) else sum(int(r["s"]) for r in each)
    fits = lambda s: s if s is not None and s <= _LONG else None
    rows = [
        (r["cluster"], None if r["lost"] else fits(int(r["s"])), fits(total), centroid_digest(centroids[r["cluster"]])) for r in each
    ]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
