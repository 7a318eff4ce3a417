"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word is a run of letters with their combining marks, in lower case. All words of all training
documents are counted by language. Known words are those of greatest relative frequency in any language,
as many as WORD_ENTRIES (word, language) pairs hold: a histogram of relative frequencies gives the
threshold, so nothing is sorted and the table is bounded. A known word scores each language by the log of
its relative frequency there. Any other word is spelt between two marks and scored by its character n-grams of
the greatest length of which one is known in any language: the mean of their log frequencies; where no
n-gram of that length is known, shorter ones, down to single characters. N-grams are counted over all
distinct words of a language, once each, as what is unseen resembles rare words, and bounded the same way.
What a language has not met scores FLOOR, the same for every language.

A document's score by language is the mean over its words, and the greatest one wins; with the root of the number of
words as its weight it gives the probabilities of which the winner's is reported. Both tables are broadcast;
a worker keeps what unseen words scored in a bounded cache. Texts are never shuffled, only counts by word.

Defined results: a null text, and one without a letter, is `und` with a score of 0, and so is every text
where no training document has a language and a word; equal scores go to the smaller language by code
point, also where no character of a text was ever met (its score is 1 over the number of languages); a null id
counts as the empty string when documents are divided; repeated rows count each, and score alike; a long
text is scored word by word with memory for its own words; an empty table gives an empty table; columns
besides doc_id, text and lang are not read. Languages are classes: one string of each is on the driver.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, held, materialize, scratch, tidy

UNKNOWN = "und"
LONGEST_GRAM = 5
#: (word, language) and, for each length, (n-gram, language) pairs of a table: at most about 100 MB in a worker.
#: A pair of greater relative frequency is never left out for one of smaller.
WORD_ENTRIES = 200_000
GRAM_ENTRIES = 60_000
#: The natural log of the frequency of what a language has not met.
FLOOR = -16.0
#: Buckets of the histogram of relative frequencies to a power of 2.
STEPS = 8
#: Longer words are spelt for their n-grams each time; others are kept while a worker's cache has room.
LONGEST_KEPT = 40
CACHE_VALUES = 1_000_000
#: Characters of texts that are worked on together.
CHUNK_CHARACTERS = 1 << 18
#: (word, language) counts that a task gathers before it hands them on.
TASK_COUNTS = 200_000

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START, END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, length: int) -> list[str]:
    """The word's n-grams, with marks at its ends but for single characters."""
    spelt = word if length == 1 else START + word + END
    return [spelt[i : i + length] for i in range(len(spelt) - length + 1)]


# ---------------------------------------------------------------- counts

_COUNTED = pa.schema([("item", pa.string()), ("lang", pa.string()), ("n", pa.int64())])
_COUNTED_DDL = "item string, lang string, n long"


def _counted(lang: str, counts: Counter) -> pa.RecordBatch:
    columns = [pa.array(counts.keys(), pa.string()), pa.repeat(pa.scalar(lang, pa.string()), len(counts)), pa.array(counts.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTED)


def _counts_of(items_of: Callable[[str | None], list[str]]) -> Callable[[Iterator], Iterator]:
    """Counts of (item, lang) of a task's (text, lang) rows, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for text, lang in zip(*(batch.column(i).slice(start, 64).to_pylist() for i in (0, 1))):
                    counts[lang].update(items_of(text))
                if sum(map(len, counts.values())) >= TASK_COUNTS:
                    yield from map(_counted, counts, counts.values())
                    counts.clear()
        yield from map(_counted, counts, counts.values())

    return run


def _all_grams(word: str) -> list[str]:
    return [g for k in range(1, LONGEST_GRAM + 1) for g in grams_of(word, k)]


def _sum_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item", "lang").agg(F.sum("n").alias("n"))


def _bucket(n: Column, total: Column) -> Column:
    return F.floor(F.log2(n / total) * STEPS).cast("int")


def most_frequent(counts: DataFrame, totals: DataFrame, entries: int, by: Column) -> DataFrame:
    """(item, lang, n, total, kind) of the pairs of greatest relative frequency, at most `entries` for each kind.

    counts: (item, lang, n); totals: (lang, kind, total), one row for each language and kind.
    """
    known = counts.withColumn("kind", by).join(totals, ["lang", "kind"])
    known = known.withColumn("bucket", _bucket(F.col("n"), F.col("total")))
    # A few hundred buckets a kind.
    sizes = known.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    lowest: dict[int, int] = {}
    held_back: dict[int, int] = {}
    for r in sorted(sizes, key=lambda r: (r["kind"], -r["bucket"])):
        so_far = held_back.get(r["kind"], 0) + r["n"]
        held_back[r["kind"]] = so_far
        if so_far <= entries:
            lowest[r["kind"]] = r["bucket"]
    keep = F.lit(False)
    for kind, bucket in lowest.items():
        keep = keep | ((F.col("kind") == kind) & (F.col("bucket") >= bucket))
    return known.filter(keep).select("item", "lang", "n", "total", "kind")


class Table:
    """Log frequencies of known items, for the languages that met them: memory by pairs, however many languages there are."""

    def __init__(self, rows: list[tuple[str, str, int, int]], languages: list[str]) -> None:
        """rows: (item, language, count, the language's total), items one after another."""
        place = {lang: i for i, lang in enumerate(languages)}
        self.row: dict[str, int] = {}
        first = []
        for i, (item, *_) in enumerate(rows):
            if item not in self.row:
                self.row[item] = len(self.row)
                first.append(i)
        self.bounds = np.array([*first, len(rows)], np.int64)
        self.lang = np.array([place[r[1]] for r in rows], np.int32)
        #: What a pair adds to FLOOR.
        self.gain = np.array([max(0.0, math.log(r[2] / r[3]) - FLOOR) for r in rows], np.float64)
        self.languages = len(languages)

    def sums(self, owners: Sequence[int], rows: Sequence[int], times: Sequence[float], n: int) -> np.ndarray:
        """By owner (of n) and language, the sum of log frequencies of the owner's items, each so many times."""
        at, owner, times = np.array(rows, np.int64), np.array(owners, np.int64), np.array(times, np.float64)
        sizes = self.bounds[at + 1] - self.bounds[at]
        pair = np.arange(sizes.sum()) + np.repeat(self.bounds[at] - np.cumsum(sizes) + sizes, sizes)
        cell = np.repeat(owner, sizes) * self.languages + self.lang[pair]
        gained = np.bincount(cell, self.gain[pair] * np.repeat(times, sizes), n * self.languages).reshape(n, self.languages)
        return gained + FLOOR * np.bincount(owner, times, n)[:, None]


class Model:
    def __init__(self, languages: list[str], words: Table, grams: Table) -> None:
        self.languages, self.words, self.grams = languages, words, grams
        #: Rows of known words, then those of unseen ones that are kept, whose scores are in one matrix.
        self.row = dict(words.row)
        self.kept: list[str] = []
        self.scores = np.zeros((0, len(languages)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """Words' scores by the longest n-grams of which one is known; zeros where none is."""
        get = self.grams.row.get
        owners, rows, times = [], [], []
        for i, word in enumerate(words):
            for length in range(LONGEST_GRAM, 0, -1):
                found = [r for r in map(get, grams_of(word, length)) if r is not None]
                if found:
                    owners += [i] * len(found)
                    rows += found
                    times += [1.0 / len(found)] * len(found)
                    break
        return self.grams.sums(owners, rows, times, len(words))

    def _forget(self) -> None:
        for word in self.kept:
            self.row.pop(word, None)
        self.kept, self.scores = [], self.scores[:0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of some texts, which are worked on together."""
        counts = [Counter(words_of(t)) for t in texts]
        met = set().union(*counts)
        if (len(self.kept) + len(met)) * len(self.languages) > CACHE_VALUES:
            self._forget()
        new = list(met - self.row.keys())
        first_unseen = len(self.words.row)
        self.row.update(zip(new, range(first_unseen + len(self.scores), first_unseen + len(self.scores) + len(new))))
        self.scores = np.concatenate([self.scores, self.unseen(new)])
        self.kept += new
        row, times = (np.fromiter(c, np.int64) for c in (map(self.row.__getitem__, itertools.chain(*counts)), itertools.chain(*(c.values() for c in counts))))
        owner = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        is_known = row < first_unseen
        total = self.words.sums(owner[is_known], row[is_known], times[is_known], len(texts))
        rest = ~is_known
        if rest.any():  # owners ascend
            owners, first = np.unique(owner[rest], return_index=True)
            total[owners] += np.add.reduceat(self.scores[row[rest] - first_unseen] * times[rest][:, None], first)
        for word in new:
            if len(word) > LONGEST_KEPT:
                del self.row[word]
        found = []
        for own, scores in zip(counts, total):
            size = own.total()
            if not size or not self.languages:
                found.append((UNKNOWN, 0.0))
                continue
            best = int(scores.argmax())  # languages ascend: ties to the smaller one
            odds = np.exp((scores - scores[best]) / math.sqrt(size))
            found.append((self.languages[best], float(1.0 / odds.sum())))
        return found


def bounded_runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of about CHUNK_CHARACTERS at most; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > CHUNK_CHARACTERS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def fit(training: DataFrame, word_entries: int = WORD_ENTRIES, gram_entries: int = GRAM_ENTRIES) -> Model:
    """The model of (text, lang) rows; rows without a language or a text teach nothing."""
    rows = training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    words = materialize(_sum_counts(rows.mapInArrow(tidy(_counts_of(words_of)), _COUNTED_DDL)), "words-by-language")
    word = F.lit(0)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("kind", word)
    known = most_frequent(words, totals, word_entries, word)
    # A distinct word of a language counts once.
    grams = materialize(_sum_counts(words.select("item", "lang").mapInArrow(tidy(_counts_of(_all_grams)), _COUNTED_DDL)), "grams-by-language")
    length = F.length("item")
    gram_totals = grams.groupBy("lang", length.alias("kind")).agg(F.sum("n").alias("total"))
    known_grams = most_frequent(grams, gram_totals, gram_entries, length)
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    pairs = lambda found: sorted(tuple(r) for r in found.select("item", "lang", "n", "total").collect())
    return Model(languages, Table(pairs(known), languages), Table(pairs(known_grams), languages))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each document's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))
    key = ("language", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held(key, lambda: Model(*shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                ids, texts = (batch.column(i).slice(start, 512) for i in (0, 1))
                found = [f for run in bounded_runs(texts.to_pylist()) for f in mine.predict(run)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=_PREDICTED)

    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return narrow.mapInArrow(tidy(run, key), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learning from documents outside the held-out fold."""
    with scratch(docs.sparkSession):
        model = fit(docs.filter(crc_mod("doc_id", folds) != 0))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
