"""Substring dedup by hashing lines.

Units are lines, cut further at sentence ends, so that a passage is found inside a longer line too.
A unit's digest is taken of its normalised words (A-Z lower-cased, outer punctuation dropped, white
space apart). Digests are grouped over the whole corpus and the occurrence of smallest (doc_id, start)
stays; the others are repeats. Adjacent repeats of a document are a run. A run is carried on, word by
word, into the units beside it as far as they agree with the units beside the occurrences that stay,
so a passage that begins or ends inside a sentence counts with its edges. Runs of at least `min_words`
words are removed (1, the default, removes every repeat), with their offsets in the original text
retained. Consecutive units of fewer than UNIT_WORDS words make one unit, which ends at a word of
chosen digest, so that two copies of a word list fall into step wherever they begin. Every word lies
in a unit, and only units that repeat are removed.

Digests are grouped with map-side combining, so a digest that fills the corpus is one row from each
task; only units whose digest stands in two places are kept, and the first place of each is found among them.

Defined results: null and empty texts have no units and stay as they are; rows that repeat both
doc_id and text are one document listed more than once; a null doc_id ranks last; equal doc_ids of
different texts rank by a hash of the text, so no tie is left; a long text is worked on alone, in
time and memory in proportion to its length; an empty table gives an empty table; other columns are
carried, and working columns take names that they lack. A text changes only where it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, scratch, tidy, unused
from tidemark.llm.kernels import U64, chunks, range_hashes, sequence_hashes, word_places

#: Words of a run from which on it is removed: every repeat, and passages as corpora remove them.
MIN_WORDS = 1
PASSAGE_WORDS = 30
UNIT_WORDS = 3
GROUP_UNITS = 24
#: Units beside runs up to which their numbers are broadcast to the texts (about 50 bytes each); beyond, a shuffle join.
BROADCAST_UNITS = 1_000_000
LAST = (1 << 63) - 1

_OUTER = np.zeros(256, bool)
_OUTER[list(b".,;:!?()[]{}\"'")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True

_UNITS = pa.schema(
    [
        ("_key", pa.int64()),
        ("_doc", pa.int64()),
        ("_no", pa.int32()),
        ("_start", pa.int64()),
        ("_end", pa.int64()),
        ("_words", pa.int32()),
        ("_digest", pa.int64()),
        ("_before", pa.int32()),
        ("_after", pa.int32()),
        ("_left", pa.int8()),
        ("_right", pa.int8()),
    ]
)
_UNITS_DDL = "_key long, _doc long, _no int, _start long, _end long, _words int, _digest long, _before int, _after int, _left tinyint, _right tinyint"
_EDGES = pa.schema([("_k", pa.int64()), ("_n", pa.int32()), ("_hashes", pa.binary()), ("_starts", pa.binary()), ("_ends", pa.binary())])
_EDGES_DDL = "_k long, _n int, _hashes binary, _starts binary, _ends binary"


def _is_outer(data: np.ndarray) -> np.ndarray:
    """Bytes of punctuation that may stand around a word: ASCII, guillemets, raised quotes and the ellipsis."""
    outer = _OUTER[data]
    two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & np.isin(data[2:], [0x9C, 0x9D, 0x9E, 0xA6]))
    outer[two] = outer[two + 1] = True
    outer[three] = outer[three + 1] = outer[three + 2] = True
    return outer


@dataclass
class Units:
    """The units of some texts, in order; words are numbered over all texts, offsets are code points of a unit's own text."""

    hashes: np.ndarray  # of each normalised word
    word_starts: np.ndarray
    word_ends: np.ndarray
    row: np.ndarray
    no: np.ndarray
    first: np.ndarray
    last: np.ndarray
    digest: np.ndarray

    @property
    def words(self) -> np.ndarray:
        return self.last - self.first + 1


def units_of(data: np.ndarray, offsets: np.ndarray) -> Units:
    starts, ends, bounds = word_places(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    # A word's ends without outer punctuation; a word of punctuation alone stays whole.
    place, inner = np.arange(len(data), dtype=np.int32), ~_is_outer(data) if len(data) > 2 else ~_OUTER[data]
    following = np.minimum.accumulate(np.where(inner, place, len(data))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(inner, place, -1))
    own_starts, own_ends = following[starts], preceding[ends - 1] + 1
    bare = own_starts >= own_ends
    hashes = range_hashes(data, np.where(bare, starts, own_starts), np.where(bare, ends, own_ends))
    n = len(starts)
    new_lines = np.cumsum(data == 10)
    stops = _STOPS[data[ends - 1]]
    stops[:-1] |= (owner[1:] != owner[:-1]) | (new_lines[starts[1:]] > new_lines[ends[:-1] - 1])
    stops[-1:] = True
    # Sentences, by their last words.
    last = np.flatnonzero(stops)
    first = np.concatenate([[0], last[:-1] + 1]) if n else last
    short = last - first + 1 < UNIT_WORDS
    closes = ~short | (hashes[last] % U64(4) == 0)
    closes[:-1] |= ~short[1:] | (owner[last[1:]] != owner[last[:-1]])
    closes[-1:] = True
    number = np.arange(len(last))
    since = number - np.maximum.accumulate(np.where(closes, number, -1)) if n else number
    closes |= (since > 0) & (since % GROUP_UNITS == 0)
    last = last[closes]
    first = np.concatenate([[0], last[:-1] + 1]) if n else last
    row = owner[last]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = points[offsets[owner]]
    no = np.arange(len(row)) - np.searchsorted(row, row)
    return Units(hashes, points[starts] - begin, points[ends] - begin, row, no, first, last, sequence_hashes(hashes, first, last))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in chunks(batch.column(2)):
            units = units_of(data, offsets)
            keys, docs = (batch.column(i).slice(at, len(offsets) - 1).to_numpy() for i in (0, 1))
            words = units.words
            beside = np.concatenate([[0], words, [0]])
            # The words beside a unit, by a byte of their hashes: where it agrees, the words themselves are looked at.
            word = np.concatenate([[0], (units.hashes >> U64(56)).astype(np.uint8).view(np.int8), [0]]).astype(np.int8)
            same = np.concatenate([[False], units.row[1:] == units.row[:-1], [False]]) if len(words) else np.zeros(1, bool)
            columns = (
                keys[units.row], docs[units.row], units.no, units.word_starts[units.first], units.word_ends[units.last], words,
                units.digest.view(np.int64), np.where(same[:-1], beside[:-2], 0), np.where(same[1:], beside[2:], 0),
                np.where(same[:-1], word[units.first], 0), np.where(same[1:], word[units.last + 2], 0),
            )
            for start in range(0, len(words), 1 << 16):
                part = [pa.array(c[start : start + (1 << 16)], f.type) for c, f in zip(columns, _UNITS)]
                yield pa.RecordBatch.from_arrays(part, schema=_UNITS)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, doc_id, start, end, n_words, n_units, kept_doc_ids): what is to be removed, one row a passage."""
    narrow = docs.select(
        _key().alias("_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("data"),
    )
    with scratch(docs.sparkSession):
        return materialize(_passages(narrow, min_words), "passages", keep=True)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, text, unit numbers): each such unit's words as hashes, with their offsets in the text."""
    for batch in batches:
        for at, data, offsets in chunks(batch.column(1)):
            units = units_of(data, offsets)
            firsts = np.searchsorted(units.row, np.arange(len(offsets) - 1))
            keys, wanted = (batch.column(i).slice(at, len(offsets) - 1).to_pylist() for i in (0, 2))
            hashes = (units.hashes >> U64(32)).astype(np.uint32)
            made = []
            for row, numbers in enumerate(wanted):
                for no in numbers:
                    if (u := firsts[row] + no) < len(units.row) and units.row[u] == row:
                        own = slice(units.first[u], units.last[u] + 1)
                        made.append((keys[row], no, hashes[own].tobytes(), units.word_starts[own].tobytes(), units.word_ends[own].tobytes()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _EDGES)], schema=_EDGES)


def _agreeing(left: pd.Series, own: pd.Series, kept: pd.Series, starts: pd.Series, ends: pd.Series, least: pd.Series) -> pd.DataFrame:
    """How many words of a unit agree with the kept one's, from the side of the run, and where they begin or end."""
    out = []
    for is_left, a, b, s, e, low in zip(left, own, kept, starts, ends, least):
        a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        s, e = np.frombuffer(s, np.int64), np.frombuffer(e, np.int64)
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n]) if is_left else np.flatnonzero(a[:n] != b[:n])
        n = int(differ[0]) if len(differ) else n
        if is_left:  # not into the kept occurrence itself
            n = min(n, int((s >= low).sum()))
        out.append((n, 0 if not n else int(s[-n]) if is_left else int(e[n - 1])))
    return pd.DataFrame(out, columns=["_more", "_to"])


def _carried_on(runs: DataFrame, narrow: DataFrame) -> DataFrame:
    """runs with start, end and n_words carried on into the units beside them.

    Only units whose word next to the run agrees with the kept one's are looked at; all others carry on by nothing.
    """
    side = lambda left, agrees, no, kept_key, kept_no, least: F.struct(
        F.lit(left).alias("_left"), agrees.alias("_agrees"), no.alias("_no"), kept_key.alias("_kept_key"), kept_no.alias("_kept_no"), least.alias("_least")
    )
    first, last = F.col("_head"), F.col("_tail")
    low = F.when(first["_kept_key"] == F.col("_key"), first["_kept_end"]).otherwise(F.lit(0))
    sides = F.array(
        side(True, first["_left"] == first["_kept_left"], first["_no"] - 1, first["_kept_key"], first["_kept_no"] - 1, low),
        side(False, last["_right"] == last["_kept_right"], last["_no"] + 1, last["_kept_key"], last["_kept_no"] + 1, F.lit(0).cast("long")),
    )
    edges = runs.select("_key", "_doc", "_run", F.explode(sides).alias("_s")).select("_key", "_doc", "_run", "_s.*").filter("_agrees and _no >= 0 and _kept_no >= 0").drop("_agrees")
    wanted = edges.select("_key", "_no").union(edges.select("_kept_key", "_kept_no")).distinct()
    by_doc = materialize(wanted.groupBy(F.col("_key").alias("_k")).agg(F.collect_list("_no").alias("_wanted")), "wanted")
    asked = by_doc.agg(F.sum(F.size("_wanted"))).first()[0] or 0
    by_doc = F.broadcast(by_doc) if asked <= BROADCAST_UNITS else by_doc
    texts = narrow.join(by_doc, narrow["_key"] == by_doc["_k"]).select("_k", "data", "_wanted").mapInArrow(tidy(_words_of), _EDGES_DDL)
    texts = materialize(texts.dropDuplicates(["_k", "_n"]), "edges")
    own = texts.withColumnsRenamed({"_k": "_key", "_n": "_no", "_hashes": "_own"})
    kept = texts.select(F.col("_k").alias("_kept_key"), F.col("_n").alias("_kept_no"), F.col("_hashes").alias("_theirs"))
    met = edges.join(kept, ["_kept_key", "_kept_no"]).join(own, ["_key", "_no"])
    agreeing = F.pandas_udf(_agreeing, "_more int, _to long")
    found = met.select("_key", "_doc", "_run", "_left", agreeing("_left", "_own", "_theirs", "_starts", "_ends", "_least").alias("_a")).filter("_a._more > 0")
    more = found.groupBy("_key", "_doc", "_run").agg(
        F.sum("_a._more").alias("_more"), F.max(F.when(F.col("_left"), F.col("_a._to"))).alias("_from"), F.max(F.when(~F.col("_left"), F.col("_a._to"))).alias("_to")
    )
    return runs.join(more, ["_key", "_doc", "_run"], "left").withColumns(
        {"start": F.coalesce("_from", "start"), "end": F.coalesce("_to", "end"), "n_words": F.col("n_words") + F.coalesce("_more", F.lit(0))}
    )


def _passages(narrow: DataFrame, min_words: int) -> DataFrame:
    units = materialize(narrow.select("_key", "_doc", "data").mapInArrow(tidy(_split), _UNITS_DDL), "units")
    # A digest that stands in two places, by the least and the greatest hash of a place: three numbers a digest are shuffled.
    at = F.xxhash64("_key", "_no")
    twice = units.groupBy(F.col("_digest").alias("_d")).agg(F.min(at).alias("_low"), F.max(at).alias("_high")).filter("_low != _high").select("_d")
    shared = units.join(materialize(twice, "digests"), units["_digest"] == F.col("_d"), "left_semi")
    shared = materialize(shared, "shared")
    place = F.struct("_doc", "_start", "_key", "_no", "_end", "_left", "_right")
    kept = shared.groupBy(F.col("_digest").alias("_d")).agg(F.min(place).alias("_first")).select(
        "_d", *(F.col(f"_first.{c}").alias(f"_kept{n}") for c, n in (("_doc", ""), ("_start", "_start"), ("_key", "_key"), ("_no", "_no"), ("_end", "_end"), ("_left", "_left"), ("_right", "_right")))
    )
    repeats = shared.join(kept, shared["_digest"] == kept["_d"]).filter(
        (F.col("_doc") != F.col("_kept")) | (F.col("_start") != F.col("_kept_start")) | (F.col("_key") != F.col("_kept_key"))
    )
    # Rows listed twice have their units twice.
    one = repeats.groupBy("_key", "_doc", "_no").agg(
        *(F.first(c).alias(c) for c in ("_start", "_end", "_words", "_before", "_after", "_kept", "_kept_key", "_kept_no", "_kept_end", "_left", "_right", "_kept_left", "_kept_right"))
    )
    in_doc = Window.partitionBy("_key", "_doc").orderBy("_no")
    runs = one.withColumn("_run", F.col("_no") - F.row_number().over(in_doc))
    at = F.struct("_no", "_before", "_after", "_kept_key", "_kept_no", "_kept_end", "_left", "_right", "_kept_left", "_kept_right")
    found = runs.groupBy("_key", "_doc", "_run").agg(
        F.min("_start").alias("start"),
        F.max("_end").alias("end"),
        F.sum("_words").cast("long").alias("n_words"),
        F.count(F.lit(1)).alias("n_units"),
        F.array_sort(F.collect_set("_kept")).alias("kept_doc_ids"),
        F.min(at).alias("_head"),
        F.max(at).alias("_tail"),
    )
    # No more can be carried on than the units beside a run hold.
    found = materialize(found.filter(F.col("n_words") + F.col("_head._before") + F.col("_tail._after") >= min_words), "runs")
    found = _carried_on(found, narrow).filter(F.col("n_words") >= min_words)
    # Two runs may reach into the same unit.
    found = found.withColumn("_past", F.lag("end").over(Window.partitionBy("_key", "_doc").orderBy("_run")))
    null_doc = F.when(F.col("_doc") != LAST, F.col("_doc"))
    return found.select(
        "_key", null_doc.alias("doc_id"), F.greatest("start", "_past").alias("start"), "end", "n_words", "n_units",
        F.transform("kept_doc_ids", lambda d: F.when(d != LAST, d)).alias("kept_doc_ids"),
    )


def without_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans; of the white space on both sides of a cut the one with more lines stays, at either end of the text none."""
    whole: list[list[int]] = []
    for start, end in sorted(spans):
        if whole and not text[whole[-1][1] : start].strip():
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([start, end])
    if not whole:
        return text
    kept = text[: whole[0][0]]
    for (_, at), (to, _) in zip(whole, [*whole[1:], [len(text), 0]]):
        kept = _joined(kept, text[at:to])
    return kept


def _joined(left: str, right: str) -> str:
    before, after = left.rstrip(), right.lstrip()
    if not before or not after:
        return before + after if before else after
    gaps = left[len(before) :], right[: len(right) - len(after)]
    return before + max(gaps, key=lambda g: g.count("\n")) + after


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "_removed") -> DataFrame:
    """docs with text cut, and the removed spans of the original text in a new column."""
    key, = unused(docs, "_key")
    with scratch(docs.sparkSession):
        spans = repeated_passages(docs, min_words).groupBy(F.col("_key").alias(key))
        spans = materialize(spans.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(removed)), "spans", keep=True)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for texts, where in batches:
                yield pd.Series([without_passages(t, [(s["start"], s["end"]) for s in r]) if t is not None and r is not None else t for t, r in zip(texts, where)], dtype=object)

        yield from tidy(run)(batches)

    keyed = docs.withColumn(key, _key()).join(spans, key, "left")
    changed = F.col(removed).isNotNull()
    whole = keyed.filter(~changed)
    touched = keyed.filter(changed).withColumn("text", cut(F.col("text").cast("string"), F.col(removed)))
    return whole.unionByName(touched).drop(key)
