"""Approximate nearest neighbours by learned partitions of a neighbour graph.

The index is fitted on SAMPLE vectors of smallest seeded hash: their exact neighbour graph is
partitioned into parts of bounded size, so that neighbours tend to share a part, and a softmax
classifier learns the parts from the vectors. It then assigns every vector to its most probable
part, and routes each query to its most probable parts, whose vectors are ranked by exact distance.
How many parts a query visits is measured: for HELD_BACK sample vectors, kept from the fit, the true
neighbours among all vectors of the table are found by a plain pass, and a query visits the fewest
parts that hold RECALL of them. This is so at every size of the table.

A part holds about PART_ROWS vectors, with at least LEAST_PARTS parts and at most one for every
SAMPLE_PER_PART sample vectors; SAMPLE is to grow with tables beyond that. A part's vectors are dealt by
hash into blocks, and its queries into others, so a group of bounded size is each task's, also where one
vector fills a third of the corpus. Queries that find fewer than k ask all parts.

Defined results: vectors that are null, zero, of another length than the most common one, or hold
null or non-finite components take no part; equal distances rank by smaller vec_id; repeated rows
are separate candidates, but a vec_id asks once (with its smallest vector, where they differ), and rows
of the query's own vec_id are never its candidates; with fewer candidates than k all are returned; an
empty table gives an empty table; a vector of any length is one row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, scratched, tidy

K = 10
QUERY_EVERY = 100
SAMPLE = 8_192
SAMPLE_PER_PART = 16
HELD_BACK = 256
PART_ROWS = 2_000
LEAST_PARTS = 8
BLOCK_ROWS = 4_000
BLOCK_QUERIES = 2_000
RECALL = 0.97
GRAPH_NEIGHBOURS = 10
SEED = 5


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0)
    )
    sizes = found.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    common = sizes.collect()
    return found.filter(F.size("v") == (common[0]["d"] if common else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows, by blocks."""
    k = min(k, len(x) - 1)
    squares = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = squares[at : at + 512, None] + squares - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def partition_graph(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Balanced parts: seeds by spread-out rows, then moves to the part of most neighbours while it has room."""
    n = len(x)
    room = -(-n * 11 // (parts * 10))
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(n, parts, replace=False)].copy()
    for _ in range(8):
        near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        for p in range(parts):
            if (near == p).any():
                centres[p] = x[near == p].mean(axis=0)
    score = x @ centres.T - 0.5 * (centres * centres).sum(axis=1)
    part, sizes = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-score.max(axis=1), kind="stable"):
        for p in np.argsort(-score[i], kind="stable"):
            if sizes[p] < room:
                part[i] = p
                sizes[p] += 1
                break
    both = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            both[i].append(int(j))
            both[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts) if both[i] else np.zeros(parts)
            for p in np.argsort(-votes, kind="stable")[:3]:
                if votes[p] <= votes[part[i]]:
                    break
                if sizes[p] < room:
                    sizes[part[i]] -= 1
                    sizes[p] += 1
                    part[i] = p
                    moved += 1
                    break
        if not moved:
            break
    return part


def fit_classifier(x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 150) -> np.ndarray:
    """Softmax weights [feature + 1, part] by full-batch gradient steps with momentum."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    goal = np.eye(parts)[part]
    scale = np.sqrt((x * x).sum(axis=1).mean())
    weights = np.zeros((x.shape[1], parts))
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        p = softmax(x @ weights)
        speed = 0.9 * speed + x.T @ (goal - p) / len(x) - 1e-5 * weights
        weights = weights + 4.0 * parts**0.5 / scale**2 * speed
    return weights


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def route(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Parts from most to least probable."""
    return np.argsort(-(x @ weights[:-1] + weights[-1]), axis=1, kind="stable")


def exact_distances(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - query) ** 2).sum(axis=1))


def nearest(queries: np.ndarray, own_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k nearest rows of x, whose ids ascend, but for its own id: places and exact distances, ties to smaller ids."""
    found = []
    squares = (x * x).sum(axis=1)
    for start in range(0, len(queries), 256):
        q = queries[start : start + 256]
        rough = squares + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T
        rough[own_ids[start : start + 256, None] == ids] = np.inf
        # Rounding moves a rough squared distance by far less than this share of the squares.
        slack = 1e-9 * (squares.max() + (q * q).sum(axis=1) + 1e-300)
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
        for one, row, most in zip(q, rough, edge + 2 * slack):
            near = np.flatnonzero((row <= most) & np.isfinite(row))
            d = exact_distances(one, x[near])
            order = np.lexsort((ids[near], d))[:k]
            found.append((near[order], d[order]))
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def true_parts(table: DataFrame, ids: np.ndarray, x: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """(query, part) of the k nearest vectors of the whole table, for a bounded number of queries."""
    shared = table.sparkSession.sparkContext.broadcast((ids, x, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, queries, w = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                one = batch.slice(start, 4096)
                order = np.argsort(one.column(0).to_numpy(), kind="stable")
                there, v = one.column(0).to_numpy()[order], _matrix(one.column(1))[order]
                parts = route(v, w)[:, 0]
                rows = [(i, float(d), int(there[n]), int(parts[n])) for i, (near, ds) in enumerate(nearest(queries, own_ids, there, v, k)) for n, d in zip(near, ds)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query", "d", "vec_id", "part"])

    by_query = Window.partitionBy("query").orderBy("d", "vec_id")
    found = table.mapInArrow(tidy(run), "query long, d double, vec_id long, part long").withColumn("rank", F.row_number().over(by_query))
    rows = found.filter(F.col("rank") <= k).select("query", "part").collect()  # k rows a query
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2)


def visits_for(ways: np.ndarray, true: np.ndarray, recall: float) -> int:
    """The fewest parts that queries have to visit, in the order of `ways`, for so much of `true`."""
    if not len(true):
        return ways.shape[1]
    place = np.empty_like(ways)
    np.put_along_axis(place, ways, np.arange(ways.shape[1])[None, :].repeat(len(ways), axis=0), axis=1)
    needed = np.sort(place[true[:, 0], true[:, 1]])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1


_FOUND_DDL = "query_id long, vec_id long, score double"


def _ask(queries: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest candidates in the parts that each query visits."""
    # How many blocks of each kind a part has: a row a part.
    blocks = assigned.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    asked = queries.select("query_id", "q", F.explode("visit").alias("part"))
    lots = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("lots"))
    sizes = F.broadcast(materialize(blocks.join(lots, "part"), "parts"))
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda key, n: F.pmod(F.xxhash64(key, F.lit(SEED)), F.col(n)).cast("int")
    # A vec_id names a vector, so its rows are few; the hash of both deals what repeats a vector.
    candidates = assigned.join(sizes, "part").select("part", dealt("vec_id", "blocks").alias("block"), F.explode(places("lots")).alias("lot"), "vec_id", "v")
    asked = asked.join(sizes, "part").select("part", F.explode(places("blocks")).alias("block"), dealt("query_id", "lots").alias("lot"), "query_id", "q")

    def rank(asked: pa.Table, offered: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and offered.num_rows:
            ids = offered.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(offered.column("v"))[order]
            own = asked.column("query_id").to_numpy()
            for query_id, (near, d) in zip(own, nearest(_matrix(asked.column("q")), own, ids, x, k)):
                out += [(int(query_id), int(i), float(s)) for i, s in zip(ids[near], d)]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ("part", "block", "lot")
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(rank, _FOUND_DDL)
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "found")


@scratched
def search(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found."""
    table = usable(vectors)
    total = table.count()
    # At most `sample` vectors reach the driver.
    rows = table.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "v").limit(sample).toArrow()
    ids, x = rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("v"))
    held = min(HELD_BACK, len(x) // 5)
    rest = x[held:]
    parts = max(1, min(max(LEAST_PARTS, total // PART_ROWS), len(rest) // SAMPLE_PER_PART))
    weights = fit_classifier(rest, partition_graph(rest, neighbour_graph(rest, GRAPH_NEIGHBOURS), parts), parts) if parts > 1 else np.zeros((x.shape[1] + 1, 1))
    visits = visits_for(route(x[:held], weights), true_parts(table, ids[:held], x[:held], weights, k), RECALL) if parts > 1 and held else parts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                one = batch.slice(start, 2048)
                ways = route(_matrix(one.column(1)), weights)
                is_query = one.column(0).to_numpy() % query_every == 0
                lists = [w[:visits].tolist() if q else [] for w, q in zip(ways, is_query)]
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1), pa.array(ways[:, 0].astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))],
                    names=["vec_id", "v", "part", "visit"],
                )

    assigned = materialize(table.mapInArrow(tidy(assign), "vec_id long, v array<double>, part int, visit array<int>"), "assigned")
    first = F.min(F.struct("v", "visit")).alias("first")
    queries = assigned.filter(F.size("visit") > 0).groupBy(F.col("vec_id").alias("query_id")).agg(first)
    queries = materialize(queries.select("query_id", F.col("first.v").alias("q"), F.col("first.visit").alias("visit")), "queries")
    found = _ask(queries, assigned, k)
    if visits == parts:
        return found
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id")
    every = F.array(*(F.lit(p) for p in range(parts)))
    short = materialize(queries.join(full, "query_id", "left_anti").withColumn("visit", every), "short")
    if short.isEmpty():
        return found
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(_ask(short, assigned, k))
