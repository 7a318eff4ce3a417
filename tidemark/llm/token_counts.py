"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the corpus's most frequent pre-tokens and their token counts. It
is found in one pass over all documents: each task keeps a bounded summary of its units (runs between
spaces), splits what is left into pre-tokens with their counts, and summaries (never the pre-tokens of
texts) are merged in a tree, at most FAN_IN to a task, until one of at most TABLE_SIZE entries is left.
The table is broadcast: at most TABLE_SIZE pre-tokens of at most UNIT_BYTES bytes. Tier two are bounded
caches in each Python worker in front of the library. No pre-token of a text is ever shuffled, and the
table affects speed only, so that summaries are bounded costs no exactness: counts are the library's.

Defined results: a null or empty text has 0 tokens and 0 bytes; a null doc_id stays null; repeated rows
give repeated results; ties in frequency go to the smaller pre-token; a long text is counted unit by
unit in memory for its units; an empty table gives an empty table; columns besides doc_id and text are
not read, so none clashes.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, held, tidy
from tidemark.llm.unit_tokens import UnitCounts, load_tokenizer, pre_tokens

TABLE_SIZE = 16_384
UNIT_BYTES = 48
#: A task's summary is cut back to its larger half when it reaches this many units.
SUMMARY_UNITS = 200_000
FAN_IN = 16

_SUMMARY = pa.schema([("part", pa.int32()), ("summary", pa.string())])
_SUMMARY_DDL = "part int, summary string"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long"


def _largest(counts: Counter, n: int) -> dict[str, int]:
    return dict(heapq.nsmallest(n, counts.items(), key=lambda kv: (-kv[1], kv[0])))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        column = batch.column(0)
        for start in range(0, len(column), 512):
            for text in column.slice(start, 512).to_pylist():
                if text:
                    counts.update(text.split(" "))
                if len(counts) > SUMMARY_UNITS:
                    counts = Counter(_largest(counts, SUMMARY_UNITS // 2))
    tokens: Counter = Counter()
    for unit, n in counts.items():
        for token in pre_tokens(unit):
            tokens[token] += n
    kept = {u: n for u, n in _largest(tokens, TABLE_SIZE).items() if len(u.encode()) <= UNIT_BYTES}
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([json.dumps(kept)])], schema=_SUMMARY)


def _merge(summaries: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for one in summaries.column("summary").to_pylist():
        counts.update(json.loads(one))
    part = summaries.column("part")[0].as_py() // FAN_IN
    return pa.table([pa.array([part], pa.int32()), pa.array([json.dumps(_largest(counts, TABLE_SIZE))])], schema=_SUMMARY)


def frequent_pre_tokens(docs: DataFrame) -> list[str]:
    """The corpus's frequent pre-tokens, most frequent first, from bounded summaries of all documents."""
    texts = docs.selectExpr("cast(text as string) as text")
    level = texts.mapInArrow(tidy(_summarise), _SUMMARY_DDL)
    parts = max(1, texts.rdd.getNumPartitions())
    while parts > 1:
        level = level.groupBy(F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(_merge, _SUMMARY_DDL)
        parts = -(-parts // FAN_IN)
    rows = level.collect()
    return list(json.loads(rows[0]["summary"])) if rows else []


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document's whole text."""
    tokenizer = load_tokenizer(vocabulary)
    lengths = {t: len(tokenizer.encode(t, add_special_tokens=False)) for t in frequent_pre_tokens(docs)}
    table = docs.sparkSession.sparkContext.broadcast(lengths)
    key = ("counts", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held(key, lambda: UnitCounts(vocabulary, table.value))

        def row(doc_id: int | None, text: str | None) -> tuple:
            text = text or ""
            return doc_id, len(text.encode()), count(text) if text else 0

        return arrow_rows(batches, _COUNTS, row)

    counted = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(tidy(run, key), _COUNTS_DDL)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
