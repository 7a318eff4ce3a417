"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is its share of the mix. What a target holds beyond whole passes over the
source is a budget of words, to be met by choosing documents. Choices are made on counts per exact
length: every length first gets its proportional part of the budget, whole documents are added
longest first until at most FIT_WORDS are left, and a bounded-knapsack dynamic programme over the
lengths still in stock meets the rest as nearly as it can. Documents of a chosen length are then
taken in a seeded order. Only lengths and counts meet in a task, one source at a time; the order
within a length is decided by seeded buckets, so a common length is never ranked in one task.

The words that a source takes miss its target by at most half its shortest document still in stock
where that is shorter than FIT_WORDS, and else by less than one document; FIT_WORDS is a parameter, and a
larger one is an exact fit of larger budgets.

Defined results: a null text has size 0 and is taken 0 words; the null source is a source of its
own, last; documents of one length and source rank by a seeded hash of doc_id and text, so reruns
agree; repeated rows tie there, and as they are equal any of them may be taken; a null doc_id is
hashed as null; a long text is one size; an empty table gives an empty table; sources without words
have target 0; other columns are carried by `mix_documents` under their own names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, scratch, tidy_group

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: No document is taken more often than this, so no target exceeds this many times its source.
MOST_PASSES = 2
SEED = 20_240_229
#: The dynamic programme's budget; what is left above it goes to whole documents, longest first.
FIT_WORDS = 65_536
#: Documents of a length and source that are ranked together.
BUCKET_ROWS = 20_000

_PICKS = pa.schema([("_source", pa.string()), ("_size", pa.int64()), ("_rows", pa.int64()), ("_picked", pa.int64()), ("_passes", pa.int64())])
_PICKS_DDL = "_source string, _size long, _rows long, _picked long, _passes long"


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): one row a source.

    Shares are by weight until a source's limit; what is above is shared again among the others.
    The limits bind in order of limit over weight, so one running sum over sources settles them.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    limits = per_source.select("source", "source_size", weight.alias("w")).withColumn(
        "most", (F.col("source_size") * MOST_PASSES).cast("double")
    )
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    shared = limits.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(SHARE)).alias("budget"),
        F.coalesce(F.sum("most").over(so_far), F.lit(0.0)).alias("given"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(so_far), F.lit(0.0))).alias("open"),
    ).withColumn("level", (F.col("budget") - F.col("given")) / F.col("open"))
    # The level rises over sources that reach their limit; the first that doesn't fixes it for the rest.
    final = shared.withColumn(
        "held", F.when(F.col("level") * F.col("w") >= F.col("most"), F.lit(None)).otherwise(F.col("level"))
    ).withColumn("final", F.first("held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return final.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("final") * F.col("w"), F.col("most")), F.col("most")).alias("target"),
    )


def fit_counts(lengths: dict[int, int], budget: int, fit_words: int = FIT_WORDS) -> dict[int, int]:
    """How many of each length to take, so that their words come as near to budget as the fit finds."""
    stock = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in stock.items())
    if budget >= total:
        return stock
    taken = {n: c * max(0, budget - fit_words) // total for n, c in stock.items()}
    left = budget - sum(n * c for n, c in taken.items())
    for n in sorted(stock, reverse=True):
        if left <= fit_words:
            break
        more = min(stock[n] - taken[n], max(0, left - fit_words + n - 1) // n, left // n)
        taken[n] += more
        left -= n * more
    # Bounded knapsack: bit s of `reached` says that the lengths so far can make s words. Sums a
    # little above what is left are kept too, as one of them may be nearer.
    spare = sorted(n for n in stock if taken[n] < stock[n])
    limit = left + min(spare[-1] if spare else 0, fit_words)
    mask = (1 << (limit + 1)) - 1
    reached = 1
    steps: list[tuple[int, int, int]] = []
    for n in reversed([n for n in spare if n <= limit]):
        many, part = min(stock[n] - taken[n], limit // n), 1
        while many > 0:
            copies = min(part, many)
            steps.append((n, copies, reached))
            reached |= reached << (n * copies) & mask
            many -= copies
            part *= 2
        if reached >> left & 1:
            break
    under = (reached & (1 << (left + 1)) - 1).bit_length() - 1
    over = reached >> left
    over = left + (over & -over).bit_length() - 1 if over else under
    at = over if over - left < left - under else under
    for n, copies, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += copies
            at -= n * copies
    return {n: c for n, c in taken.items() if c}


def _choose(table: pa.Table, fit_words: int = FIT_WORDS) -> pa.Table:
    """One source's (length, rows) and target -> how often all and how many more of each length."""
    lengths = dict(zip(table.column("_size").to_pylist(), table.column("_rows").to_pylist()))
    total = sum(n * c for n, c in lengths.items())
    target = round(table.column("_target")[0].as_py())
    passes = min(target // total, MOST_PASSES) if total else 0
    picked = fit_counts(lengths, target - passes * total, fit_words) if passes < MOST_PASSES and total else {}
    name = table.column("_source")[0].as_py()
    rows = [(name, n, c, picked.get(n, 0), passes) for n, c in sorted(lengths.items())]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PICKS)], schema=_PICKS)


def mix_documents(
    docs: DataFrame, seed: int = SEED, size: str = "_size", source_size: str = "_source_size", target: str = "_target", copies: str = "_copies", fit_words: int = FIT_WORDS
) -> DataFrame:
    """docs with four new columns: its size, its source's size and target, and how often each document is taken (0, 1 or 2)."""
    spark = docs.sparkSession
    row = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # the caller's columns, out of the way of ours
    sized = docs.select(
        *(F.col(f"`{c}`").alias(r) for c, r in row.items()),
        F.col("source").cast("string").alias("_source"),
        word_count().alias("_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")).alias("_order"),
    )
    with scratch(spark):
        small = materialize(sized.select("_source", "_size"), "sizes")
        histogram = materialize(small.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_rows")), "histogram")
        targets = source_targets(histogram.select(F.col("_source").alias("source"), (F.col("_size") * F.col("_rows")).alias("size")))
        targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
        targets = materialize(targets, "targets", keep=True)
        same_source = F.col("h._source").eqNullSafe(F.col("t._source"))
        with_target = histogram.alias("h").join(targets.alias("t"), same_source).select("h._source", "_size", "_rows", "_target")
        picks = materialize(with_target.groupBy("_source").applyInArrow(tidy_group(lambda part: _choose(part, fit_words)), _PICKS_DDL), "picks", keep=True).alias("p")

    keyed = (
        sized.alias("d")
        .join(picks, F.col("d._source").eqNullSafe(F.col("p._source")) & (F.col("d._size") == F.col("p._size")))
        .select("d.*", "_rows", "_picked", "_passes")
    )
    ours = {"_size": size, "_source_size": source_size, "_target": target, "_copies": copies}
    return _rank(keyed, targets).select(*(F.col(r).alias(c) for c, r in row.items()), *(F.col(c).alias(n) for c, n in ours.items()))


def _rank(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """Seeded choice of _picked of each (_source, _size): by buckets of the seeded order, then inside one bucket."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / BUCKET_ROWS)).cast("long")
    partial = (F.col("_picked") > 0) & (F.col("_picked") < F.col("_rows"))
    bucketed = keyed.withColumn("_bucket", F.when(partial, F.pmod(F.col("_order"), buckets)).otherwise(F.lit(None)))
    settled = bucketed.filter(F.col("_bucket").isNull()).withColumn("_more", (F.col("_picked") > 0).cast("long"))
    open_rows = bucketed.filter(F.col("_bucket").isNotNull())
    counts = open_rows.filter(buckets > 1).groupBy("_source", "_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    started = open_rows.join(
        starts, open_rows["_source"].eqNullSafe(starts["_s"]) & (open_rows["_size"] == starts["_z"]) & (open_rows["_bucket"] == starts["_b"]), "left"
    ).withColumn("_start", F.coalesce("_start", F.lit(0)))
    within = Window.partitionBy("_source", "_size", "_bucket").orderBy("_order")
    chosen = started.withColumn("_more", (F.row_number().over(within) + F.col("_start") <= F.col("_picked")).cast("long"))
    columns = [c for c in settled.columns if c not in ("_order", "_bucket", "_rows", "_picked")]
    both = settled.select(columns).unionByName(chosen.select(columns)).withColumn("_copies", F.col("_passes") + F.col("_more"))
    return (
        both.drop("_passes", "_more")
        .alias("d")
        .join(targets.alias("t"), F.col("d._source").eqNullSafe(F.col("t._source")))
        .select("d.*", "_source_size", "_target")
    )
