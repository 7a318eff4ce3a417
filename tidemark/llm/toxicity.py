"""Toxicity by class-conditional Kneser-Ney models.

Words are lower-cased runs between white space, stripped of outer punctuation and spelt as
characters between a start and an end mark. Each class has its own counts of characters after
contexts of ORDER - 1 characters. RARE is taken off each count, and what that frees goes to one
backoff distribution that both classes share: interpolated Kneser-Ney of the pooled counts, then of
continuation counts of all shorter contexts. So an expression that is rare in both classes is judged
alike by both, and an inflected one by its nearest common stem. In a toxic text one word in
1 / TOXIC_SHARE is drawn from the toxic class's counts and the others are ordinary, so a text's toxic
log-likelihood is the sum of log((1 - TOXIC_SHARE) * ordinary + TOXIC_SHARE * toxic) of its words. Both
log-likelihoods are normalised by the root of the number of words, and a slope and an intercept,
fitted on labelled documents that the counts never saw, turn their difference into a score.

The counts come from at most MOST_LABELLED labelled documents of each class and LABELLED_BYTES of
their whole texts, in a seeded order: a bounded sample of labelled rows, as a classifier may use.
Only their ids are broadcast to pick them. Every document is scored on its whole text.

Defined results: a null or empty text scores as a text whose difference is 0; labels repeated for
a document count once, toxic if any says so; null labels and null ids are left out; if a class has
no labelled document, every score is 0 (1 if all are toxic); an empty table gives an empty table;
repeated rows score alike; ties cannot arise, as each row is scored by itself; a long text is scored
with memory for its own words; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, give_back, held, materialize, scratch, tidy
from tidemark.llm.kernels import U64, HashTable, mix

ORDER = 6
#: Taken off each class's count of a gram; what occurs no more often is left to the shared backoff.
RARE = 3.0
#: The share of a toxic text's words that are drawn from the toxic class's counts.
TOXIC_SHARE = 0.01
MOST_LABELLED = 3_000
LABELLED_BYTES = 48 << 20
SEED = 41
THRESHOLD = 0.7
OUTER = ".,;:!?()[]{}\"'«»„“”…*#%$&"
#: One labelled document in this many fits the curve instead of the counts.
CURVE_FOLD = 4
#: Scores of words that a worker keeps.
CACHE_WORDS = 60_000

_ROLL = 0x9E3779B97F4A7C55


def _spell(word: str) -> str:
    return "\x02" + word.strip(OUTER) + "\x03"


def _discount(counts: Counter) -> float:
    ones = sum(1 for c in counts.values() if c == 1)
    twos = sum(1 for c in counts.values() if c == 2)
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class Backoff:
    """Interpolated Kneser-Ney of a character after the contexts that both classes share, by context length."""

    def __init__(self, counts: list[Counter], alphabet: int) -> None:
        self.floor = 1.0 / alphabet
        self.known: list[dict[str, float]] = []
        self.spare: list[dict[str, float]] = []
        for k, own in enumerate(counts):
            discount = _discount(own)
            totals, kinds = Counter(), Counter()
            for g, c in own.items():
                totals[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.spare.append({h: discount * kinds[h] / totals[h] for h in totals})
            self.known.append({})
            for g, c in own.items():
                lower = self(g[1:], k - 1)
                self.known[k][g] = (c - discount) / totals[g[:-1]] + self.spare[k][g[:-1]] * lower

    def __call__(self, gram: str, k: int) -> float:
        """The probability of gram's last character after the k before it."""
        weight = 1.0
        while k >= 0:
            found = self.known[k].get(gram)
            if found is not None:
                return weight * found
            weight *= self.spare[k].get(gram[:-1], 1.0)
            gram = gram[1:]
            k -= 1
        return weight * self.floor


class Model:
    """The two classes' probabilities of a character after up to ORDER - 1 others."""

    def __init__(self, words: Mapping[str, tuple[int, int]] | Iterable[tuple[str, tuple[int, int]]]) -> None:
        """words: ordinary and toxic occurrences of each unit."""
        self.counts = (Counter(), Counter())
        alphabet, longer = set(), set()  # longer: distinct grams with a character before them
        for unit, both in words.items() if isinstance(words, Mapping) else words:
            spelt = _spell(unit)
            alphabet.update(spelt)
            for i in range(1, len(spelt)):
                start = max(0, i - ORDER + 1)
                gram = spelt[start : i + 1]
                for c in (0, 1):
                    if both[c]:
                        self.counts[c][gram] += both[c]
                longer.update(spelt[s : i + 1] for s in range(start, i))
        pooled = [Counter() for _ in range(ORDER - 1)]  # by context length: gram -> number of characters that precede it
        for g in longer:
            pooled[len(g) - 2][g[1:]] += 1
        del longer
        whole = Counter()
        for own in self.counts:
            whole.update(own)
        # A gram's own length tells its context's; grams at a word's start have shorter ones, and whole counts.
        self.pooled = Backoff([*pooled, Counter()], len(alphabet) + 1)
        self.whole_discount = _discount(whole)
        totals, kinds = Counter(), Counter()
        for g, c in whole.items():
            totals[g[:-1]] += c
            kinds[g[:-1]] += 1
        self.whole, self.totals, self.kinds = whole, totals, kinds
        self.class_totals, self.free = (Counter(), Counter()), (Counter(), Counter())
        for c, own in enumerate(self.counts):
            for g, n in own.items():
                self.class_totals[c][g[:-1]] += n
                self.free[c][g[:-1]] += min(n, RARE)

    def shared(self, gram: str) -> float:
        """The backoff distribution of both classes."""
        context, lower = gram[:-1], self.pooled(gram[1:], len(gram) - 2)
        total = self.totals[context]
        if not total:
            return lower
        kept = max(self.whole[gram] - self.whole_discount, 0.0) if gram in self.whole else 0.0
        return kept / total + self.whole_discount * self.kinds[context] / total * lower

    def spare(self, context: str, c: int) -> float:
        total = self.class_totals[c][context]
        return self.free[c][context] / total if total else 1.0

    def probability(self, gram: str, c: int) -> float:
        total = self.class_totals[c][gram[:-1]]
        kept = max(self.counts[c][gram] - RARE, 0.0) / total if total else 0.0
        return kept + self.spare(gram[:-1], c) * self.shared(gram)

    def ratios(self) -> tuple[dict[str, float], dict[str, float]]:
        """Log of toxic over ordinary probability by gram, and by context for a character unseen after it (both back off alike)."""
        grams = {g: math.log(self.probability(g, 1) / self.probability(g, 0)) for g in self.whole}
        contexts = {h: math.log(self.spare(h, 1) / self.spare(h, 0)) for h in self.totals}
        return grams, contexts


def _codes(letters: np.ndarray) -> np.ndarray:
    return mix(letters.astype(U64) + U64(1))


def gram_hashes(spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram, hash of its context, word) of each character after a word's first."""
    lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
    codes = _codes(np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32))
    owner = np.repeat(np.arange(len(spelt)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    context = np.zeros(len(codes), U64)
    for m in range(1, ORDER):
        there = np.flatnonzero(place >= m)
        context[there] += codes[there - m] * U64(pow(_ROLL, m, 1 << 64))
    keep = place > 0
    size = np.minimum(place, ORDER - 1).astype(U64) + U64(1)
    return mix(context + codes + size)[keep], mix(context + size)[keep], owner[keep]


class Scorer:
    """A worker's scorer of whole texts: the difference of both normalised log-likelihoods."""

    def __init__(self, grams: HashTable, contexts: HashTable) -> None:
        self.grams, self.contexts = grams, contexts
        self.known: dict[str, float] = {}

    @classmethod
    def of(cls, model: Model) -> Scorer:
        tables = []
        for number, ratios in enumerate(model.ratios()):
            # A context is hashed with the place of a character after it, which is not read.
            hashes = gram_hashes([g + "\x00" * number for g in ratios])
            last = np.append(np.flatnonzero(np.diff(hashes[2])), len(hashes[2]) - 1) if len(hashes[2]) else np.zeros(0, np.int64)
            tables.append(HashTable(hashes[number][last], np.fromiter(ratios.values(), np.float32, len(ratios))))
        return cls(*tables)

    def ratios(self, units: list[str]) -> np.ndarray:
        """Log of the toxic over the ordinary probability of each unit."""
        out = np.empty(len(units))
        for start in range(0, len(units), 8192):
            grams, contexts, owner = gram_hashes([_spell(u) for u in units[start : start + 8192]])
            found, there = self.grams.find(grams)
            rest = np.flatnonzero(~there)
            found = found.astype(np.float64)
            found[rest] = self.contexts.find(contexts[rest])[0]
            out[start : start + 8192] = np.bincount(owner, found, minlength=len(units[start : start + 8192]))
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The difference for each of a few texts."""
        units = [(t or "").lower().split() for t in texts]
        new = list(set().union(*units) - self.known.keys())
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set().union(*units))
        self.known.update(zip(new, np.logaddexp(math.log1p(-TOXIC_SHARE), math.log(TOXIC_SHARE) + self.ratios(new)).tolist()))
        return np.array([math.fsum(map(self.known.__getitem__, u)) / math.sqrt(len(u)) if u else 0.0 for u in units])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression, by Newton steps with a small ridge."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.stack([np.ones_like(x), x / scale], axis=1)
    beta, ridge = np.zeros(2), 1e-3 * np.eye(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] / scale)


def probability(difference: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * difference, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, for_curve) of a bounded number of training documents a class, and all such documents' number by class."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(most) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(
        F.col("doc_id").alias("_id"), "toxic", order.alias("order"), (F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(CURVE_FOLD)) == 0).alias("for_curve")
    )
    # At most 2 * most ids: broadcasting them leaves the texts where they are.
    texts = docs.selectExpr("cast(doc_id as long) as _id", "cast(text as string) as text")
    met = materialize(texts.join(F.broadcast(ids), "_id"), "labelled")
    before = Window.partitionBy("toxic").orderBy("order", "_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before), F.lit(0))
    return met.withColumn("before", sizes).filter(F.col("before") < LABELLED_BYTES // 2).select("text", "toxic", "for_curve"), totals


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for unit in (text or "").lower().split():
                counts[unit][toxic] += 1
    units = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(units, pa.string()), *(pa.array([counts[u][c] for u in units], pa.int64()) for c in (0, 1))],
        names=["unit", "ordinary", "toxic"],
    )


def _words(counted: pa.Table) -> Iterator[tuple[str, tuple[int, int]]]:
    """(unit, (ordinary, toxic)) of counted units, a batch at a time as Python objects."""
    for batch in counted.to_batches(max_chunksize=8192):
        units, ordinary, toxic = (column.to_pylist() for column in batch.columns)
        yield from zip(units, zip(ordinary, toxic))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Scorer, tuple[float, float]] | float:
    """Scorer and curve, or the constant score where a class has no labelled document."""
    sample, totals = labelled_sample(docs, labels, most)
    if not totals.get(0) or not totals.get(1):
        return 1.0 if totals.get(1) else 0.0
    counted = (
        sample.filter("not for_curve")
        .select("text", "toxic")
        .mapInArrow(tidy(_count_units), "unit string, ordinary long, toxic long")
        .groupBy("unit")
        .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    scorer = Scorer.of(Model(_words(counted.toArrow())))
    rows = sample.filter("for_curve").select("text", "toxic").toArrow()
    y = rows.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():  # too few labels for a curve of their own
        return scorer, (-2.0, 10.0)
    share = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y == 0).sum()))
    found = np.concatenate([scorer([text.as_py()]) for text in rows.column("text")])
    return scorer, fit_curve(found, y, share / share.mean())


def score_column(docs: DataFrame, labels: DataFrame, column: str, most: int = MOST_LABELLED) -> DataFrame:
    """docs with its text's score in a new column; no shuffle, other columns pass by."""
    with scratch(docs.sparkSession):
        fitted = fit(docs, labels, most)
    give_back()  # the driver's Python else keeps what the counts took, fit after fit
    if isinstance(fitted, float):
        return docs.withColumn(column, F.lit(fitted))
    scorer, curve = fitted
    tables = docs.sparkSession.sparkContext.broadcast((scorer.grams, scorer.contexts))
    key = ("toxicity", uuid.uuid4().hex)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mine = held(key, lambda: Scorer(*tables.value))
            for texts in batches:
                found = [mine(texts.iloc[i : i + 64].tolist()) for i in range(0, len(texts), 64)]
                yield pd.Series(probability(np.concatenate(found), curve) if found else np.zeros(0))

        yield from tidy(run, key)(batches)

    return docs.withColumn(column, judge(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return score_column(narrow, labels, "score").select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
