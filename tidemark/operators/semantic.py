"""Semantic retrieval: vectors of an embedding space, narrowed before they are ranked, nearest ones by exact distance.

A vector table has a row for each embedded part of an entity: (vector_id, entity_id, space_id, v, fingerprint,
type, project_id, workstream_id, session_id, observed_at). It is stored by space and by a hash of the project,
so a search reads its own folders. Queries and vectors meet in blocks: those of one scope and size are dealt by
hash into groups of bounded size, each pair of groups is one task's, and only each block's nearest ones are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import evidence, filters

BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
METRICS = ("cosine", "dot", "l2")
#: What makes two embedding spaces one; fixed values.
SPACE_COLUMNS = ("provider", "model", "revision", "dimensions", "metric", "normalization")
PROJECT_BUCKETS = 32
#: What a provider says of itself, and what a search says of its semantic branch.
CAPABILITIES = ("disabled", "loading", "not_downloaded", "ready", "failed")
STATES = ("disabled", "not_applicable", "indexing", "unavailable", "ready")


class Provider(Protocol):
    """What embeds texts: batches of a column, in the tasks that hold them."""

    def capability(self) -> tuple[str, str | None]: ...

    def manifest(self) -> Mapping[str, object]: ...

    def embed(self, texts: Column) -> Column: ...


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, so that equal vectors have equal distances."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            return np.sqrt(((x - q) ** 2).sum(axis=1))
        dot = (x * q).sum(axis=1)
        return -dot if metric == "dot" else 1 - dot / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, metric: str, k: int, same: Sequence[str] = ()) -> DataFrame:
    """Exact (query_id, vec_id, distance, rank) of (vec_id, v) for (query_id, q) of equal size, and equal in the columns of `same`.

    Nearest first, ties to smaller ids. Vectors that are null or hold nulls take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    whole = lambda df, c: df.filter(F.col(c).isNotNull() & ~F.exists(c, lambda e: e.isNull()) & (F.size(c) > 0)).withColumn("_d", F.size(c))
    # A null of `same` meets a null.
    group = [F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in same)), {"ignoreNullFields": "false"}).alias("_same")] if same else [F.lit("").alias("_same")]
    there = whole(vectors, "v").select("vec_id", "v", "_d", *group)
    asked = whole(queries, "q").select("query_id", "q", "_d", *group)
    key = ["_same", "_d"]
    parts = lambda df, rows, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))
    sizes = parts(there, BLOCK_ROWS, "_blocks").join(parts(asked, BLOCK_QUERIES, "_lots"), key)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = there.join(sizes, key).select(*key, dealt("vec_id", "_blocks").alias("_block"), every("_lots").alias("_lot"), "vec_id", "v")
    asked = asked.join(sizes, key).select(*key, every("_blocks").alias("_block"), dealt("query_id", "_lots").alias("_lot"), "query_id", "q")
    kinds = (queries.schema["query_id"].dataType, vectors.schema["vec_id"].dataType)

    def rank(asked: pa.Table, there: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if asked.num_rows and there.num_rows:
            there = there.sort_by("vec_id")
            x = _rows(there.column("v")).astype(np.float64)
            for i, q in enumerate(_rows(asked.column("q")).astype(np.float64)):
                d = _distances(x, q, metric)
                edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                near = np.flatnonzero(~(d > edge))  # with what ties the last one, and what has no number
                near = near[np.argsort(d[near], kind="stable")][:k]
                found.append((i, near, d[near]))
        at = np.concatenate([np.full(len(n), i) for i, n, _ in found]) if found else np.zeros(0, np.int64)
        near, d = (np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in (1, 2))
        return pa.table([asked.column("query_id").take(pa.array(at, pa.int64())), there.column("vec_id").take(pa.array(near.astype(np.int64))), pa.array(d, pa.float64())], names=["query_id", "vec_id", "distance"])

    groups = [*key, "_block", "_lot"]
    made = asked.groupBy(*groups).cogroup(there.groupBy(*groups)).applyInArrow(rank, f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, distance double")
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return made.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def narrowed(
    vectors: DataFrame, space_id: str, boundary: Mapping[str, str | None] | None = None, types: Sequence[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Vectors of a space inside a scope, of some types and times."""
    found = vectors.filter((F.col("space_id") == space_id) & filters.in_time(F.col("observed_at"), start, end))
    if types:
        found = found.filter(F.coalesce(F.col("type").isin(*types), F.lit(False)))
    for part in ("project_id", "workstream_id", "session_id"):
        if boundary and boundary.get(part) is not None:
            found = found.filter(F.col(part) == boundary[part])
    return found


def nearest_entities(vectors: DataFrame, queries: DataFrame, metric: str, k: int, same: Sequence[str] = ()) -> DataFrame:
    """(query_id, entity_id, vec_id, fingerprint, distance, rank): each entity once, by its nearest vector.

    An entity has at most a few vectors; as many more are looked at, and again until k entities are found or none is left.
    """
    table = vectors.withColumnRenamed("vector_id", "vec_id")
    most = table.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    found = nearest(table, queries, metric, k * most, same).join(table.select("vec_id", "entity_id", "fingerprint"), "vec_id")
    best = Window.partitionBy("query_id", "entity_id").orderBy("rank")
    once = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    by = Window.partitionBy("query_id").orderBy("rank")
    return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "entity_id", "vec_id", "fingerprint", "distance", "rank")


class VectorTable:
    """Stored vectors, in folders by space and by a hash of the project."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @staticmethod
    def _bucket() -> Column:
        return F.pmod(F.xxhash64("project_id"), F.lit(PROJECT_BUCKETS)).cast("int")

    def write(self, vectors: DataFrame, dimensions: int) -> None:
        """Append valid vectors; others are refused."""
        bad = vectors.filter(~evidence.valid_vector(F.col("v"), dimensions))
        if not bad.isEmpty():
            raise ValueError(f"vectors of the space have {dimensions} finite components")
        vectors.withColumn("bucket", self._bucket()).write.mode("append").partitionBy("space_id", "bucket").parquet(self.path)

    def without(self, sessions: DataFrame, path: str) -> VectorTable:
        """The vectors but those of some sessions, as a table in another place."""
        rows = self.spark.read.parquet(self.path)
        rows.join(sessions, "session_id", "left_anti").select(rows.columns).write.partitionBy("space_id", "bucket").parquet(path)
        return VectorTable(self.spark, path)

    def read(self, space_id: str, project_id: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path).withColumn("space_id", F.col("space_id").cast("string")).filter(F.col("space_id") == space_id)
        if project_id is not None:
            wanted = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(project_id)), F.lit(PROJECT_BUCKETS)).cast("int")).first()[0]
            rows = rows.filter(F.col("bucket") == wanted)
        return rows.drop("bucket")


def embedded(content: DataFrame, provider: Provider, space_id: str) -> DataFrame:
    """A vector table of content (entity_id, type, title, body, fingerprint, scope, observed_at): batches are embedded where they lie."""
    said = F.concat_ws("\n", F.nullif("title", F.lit("")), "body")
    return content.select(
        F.sha2(F.concat_ws("\x00", F.lit(space_id), "entity_id", "fingerprint"), 256).alias("vector_id"), "entity_id", F.lit(space_id).alias("space_id"), provider.embed(said).alias("v"),
        "fingerprint", "type", "project_id", "workstream_id", "session_id", "observed_at",
    )


@dataclass
class Found:
    """What the semantic branch has to say: its state, and candidates where it is ready."""

    state: str
    reason: str | None = None
    candidates: DataFrame | None = None


def retrieve(
    query: str,
    provider: Provider | None,
    spaces: DataFrame | None,
    table: VectorTable | None,
    boundary: Mapping[str, str | None],
    limit: int = 50,
    types: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    paths: Sequence[str] | None = None,
    branch: str | None = None,
) -> Found:
    """(entity_id, rank, fingerprint, distance) of the nearest entities; what is missing or fails becomes a state, never an error."""
    if provider is None or spaces is None or table is None:
        return Found("disabled")
    if paths or branch is not None:
        return Found("not_applicable", "paths and branches are known to the lexical index alone")
    try:
        said, reason = provider.capability()
        if said != "ready":
            return Found({"disabled": "disabled", "loading": "indexing", "not_downloaded": "indexing"}.get(said, "unavailable"), reason)
        active = spaces.filter("status = 'active'").limit(1).collect()
        if not active:
            return Found("indexing", "no embedding space is active")
        space, manifest = active[0].asDict(), provider.manifest()
        if any(space.get(c) != manifest.get(c) for c in SPACE_COLUMNS):
            return Found("unavailable", "the provider is not that of the active space")
        asked = table.spark.createDataFrame([(0, query)], "query_id int, text string").select("query_id", provider.embed(F.col("text")).alias("q"))
        if asked.filter(~evidence.valid_vector(F.col("q"), int(space["dimensions"]))).limit(1).count():
            return Found("unavailable", "the query's vector does not belong to the space")
        among = narrowed(table.read(space["space_id"], boundary.get("project_id")), space["space_id"], boundary, types, start, end)
        found = nearest_entities(among, asked, str(space["metric"]), limit)
        return Found("ready", None, found.select("entity_id", "rank", "fingerprint", "distance"))
    except Exception as e:  # a broken provider or table costs the branch, not the search
        return Found("unavailable", type(e).__name__)
