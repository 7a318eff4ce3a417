"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Documents become pieces of at most CAPACITY tokens. Packing depends on lengths alone, so it is
planned on counts per length (at most CAPACITY numbers reach the driver, whatever the corpus):
lengths above a third of a sequence are matched greedily, the longest with the longest that fits,
at most two to a bin; shorter ones go, longest first, to the fullest bin that still holds them.
The plan is a list of patterns with a number of bins each. Each piece then finds its place by its
rank among the pieces of its length: ranks come from per-task counters and offsets of tasks, so
no length, however common, is gathered or sorted in one task.

Defined results: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are
packed each; pieces of one length tie, and any of them may take a place of that length; a long text is
encoded whole and cut into pieces; an empty table gives an empty table; columns besides doc_id and text
are not read, so none clashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, materialize, scratched, tidy
from tidemark.llm.unit_tokens import worker_ids

CAPACITY = 1024
END_ID = 2

_PIECES = pa.schema(
    [
        ("task", pa.int32()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("local", pa.int64()),
    ]
)
_PIECES_DDL = "task int, doc_id long, piece int, start long, length long, ids_crc32 long, local long"

Pattern = tuple[tuple[int, int], ...]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns ((length, copies), ...) with their number of bins that hold counts[length] pieces each."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece does not fit a sequence")
    by_gap: dict[int, list[tuple[Pattern, int]]] = {}

    def put(pattern: Pattern, bins: int) -> None:
        if bins:
            by_gap.setdefault(capacity - sum(n * c for n, c in pattern), []).append((pattern, bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:
            if m > n or m > capacity - n or not left[m]:
                continue
            pairs = left[n] // 2 if m == n else min(left[n], left[m])
            if not pairs:
                continue
            put(((n, 2),) if m == n else ((n, 1), (m, 1)), pairs)
            left[n] -= pairs
            left[m] -= pairs
            if not left[n]:
                break
        put(((n, 1),), left[n])
        left[n] = 0
    for n in sorted((n for n in left if left[n]), reverse=True):
        todo = left[n]
        while todo:
            gap = min((g for g in by_gap if g >= n), default=capacity)
            each = gap // n
            if gap in by_gap:
                pattern, bins = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
            else:
                pattern, bins = (), -(-todo // each)
            full = min(bins, todo // each)
            put((*pattern, (n, each)), full)
            todo -= full * each
            bins -= full
            if bins and 0 < todo < each:
                put((*pattern, (n, todo)), 1)
                todo, bins = 0, bins - 1
            if pattern:
                put(pattern, bins)
    return [one for gap in sorted(by_gap) for one in by_gap[gap]]


def slots(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, first bin, offset): where the pieces of a length go by rank."""
    rows, ranks, first = [], {}, 0
    for pattern, bins in plan:
        at = 0
        for length, copies in pattern:
            for _ in range(copies):
                rank = ranks.get(length, 0)
                rows.append((length, rank, rank + bins, first, at))
                ranks[length] = rank + bins
                at += length
        first += bins
    return rows


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each whole document's ids and the end id, with their number within task and length."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = worker_ids(vocabulary)
        local: dict[int, int] = {}

        def row(doc_id: int | None, text: str | None) -> list[tuple]:
            ids = encode(text or "") + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            made = []
            for piece, (start, to) in enumerate(zip(cuts, cuts[1:])):
                length = to - start
                k = local.get(length, 0)
                local[length] = k + 1
                made.append((task, doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * to]), k))
            return made

        return arrow_rows(batches, _PIECES, row)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(tidy(run, ("ids", vocabulary)), _PIECES_DDL)


@scratched
def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    per_task = pieces.groupBy("task", "length").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        slots(plan_bins(totals, capacity)), "length long, from_rank long, to_rank long, first_bin long, offset long"
    )
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    # The plan has at most a few patterns for each of `capacity` lengths, whatever the corpus.
    placed = ranked.join(
        F.broadcast(places),
        (ranked["length"] == places["length"]) & (ranked["rank"] >= places["from_rank"]) & (ranked["rank"] < places["to_rank"]),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_bin") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
        "offset",
    )
