"""Language-model scoring by subword lattices.

A word, after a start mark, is a lattice of the pieces of an existing subword vocabulary. The
vocabulary's scores weight all its segmentations (they are merge ranks, so a piece of rank r starts
at 1 / (r + RANK_SHIFT)), and expectation-maximisation over all distinct training words moves these
weights to unigram probabilities of the corpus. A forward recursion in log space sums over every
segmentation. Beside it each lattice has one arc for the whole word, weighted by its discounted count
in the training documents; what the discounts free goes to the pieces, so the weights of all words and
the end sum to at most one. A text draws its words from an urn that starts with URN such weights and
gets one more of each word drawn, so what a text has said before is likelier in it. There are up to
KINDS such models for kinds of documents, found without labels, and a text's probability is the
marginal over kinds and over all segmentations of all words and the end.

Counting is map-side first: tasks keep bounded tables of counts and only sums are shuffled. In
scoring, the most frequent TIER words are broadcast as 64-bit hashes with their scores (at most
TIER * (16 + 8 * KINDS) bytes, whatever the words' lengths), and of other words only hashes with their
number in a text are shuffled to meet their counts; no such word has more than 1 / TIER of all tokens.

Bounded samples: the mixture's start is found on SAMPLE distinct training ids; its rounds, counts,
piece weights and scores cover all documents and whole texts.

Defined results: a null or empty text is the end token alone; a null doc_id counts as the empty
text in the fold; repeated rows score alike; without training documents every score is that of
the untrained lattice and the base is 1 / 1; ties cannot arise, as each row is scored by itself; a
long text is worked on alone; an empty table gives an empty table; columns besides doc_id and text
are not read. Words are taken for equal when their 64-bit hashes are.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, crc_mod, held, materialize, scratched, tidy
from tidemark.llm.kernels import HashTable, U64, Words, chunks, words_of

KINDS = 10
SAMPLE = 3_000
#: Gain in likelihood, as a share of it, below which the mixture is left as it is.
STILL = 1e-3
BUCKETS = 2_048
SEED = 97
ROUNDS = 2
DISCOUNT = 0.7
RANK_SHIFT = 50.0
URN = 3_000.0
TIER = 131_072
FILTER_BITS = 20
#: Words a task counts before it hands its counts on.
TABLE_WORDS = 200_000
START = "▁"
UNSEEN = 0


#: Multiplier of the rolling hash of substrings; any odd number without structure does.
ROLL = np.uint64(0x9E3779B97F4A7C55)


def _letters(words: list[str], size: int) -> np.ndarray:
    """Code points [word, place] of words of one size."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64)


class Pieces:
    """A subword vocabulary's pieces by hash, and their first log weights; piece 0 spells a character by its bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.longest = 1
        numbers: dict[str, int] = {}
        ranks = [1000.0]
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
            if piece and not special and piece not in numbers:
                self.longest = max(self.longest, len(piece))
                numbers[piece] = len(ranks)
                ranks.append(-model.get_score(i))
        weights = 1.0 / (np.array(ranks) + RANK_SHIFT)
        self.first = np.log(weights / weights.sum())
        self.keys, self.numbers = np.array([self._hash(p) for p in numbers], U64), np.array(list(numbers.values()), np.int32)
        self.table = HashTable(self.keys, self.numbers)
        # Most substrings are no pieces: one bit of a hash rules most of them out.
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self._bits(self.keys)] = True

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        return (hashes * U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - FILTER_BITS)

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(ROLL) + ord(c) + 1) % (1 << 64)
        return value

    def find(self, hashes: np.ndarray, none: int) -> np.ndarray:
        flat = hashes.ravel()
        out = np.full(len(flat), none, np.int32)
        open_ = np.flatnonzero(self.maybe[self._bits(flat)])
        numbers, there = self.table.find(flat[open_])
        out[open_[there]] = numbers[there]
        return out.reshape(hashes.shape)


def pieces_of(path: str) -> Pieces:
    """Read once for the model that a worker holds."""
    return Pieces(path)


class Lattice:
    """Forward and backward recursions of words under log piece weights of shape (pieces, kinds)."""

    def __init__(self, pieces: Pieces, weights: np.ndarray) -> None:
        self.pieces = pieces
        # Single precision is enough for logs of words' probabilities, and twice as fast.
        none = np.full((1, weights.shape[1]), -np.inf)
        self.weights = np.concatenate([weights, none]).astype(np.float32)
        self.none = len(weights)

    def arcs(self, words: list[str]) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
        """Piece numbers by (start, length) where some word has a piece, and the cost of spelling by bytes [word, start]."""
        size = len(words[0]) + 1
        letters = _letters([START + w for w in words], size)
        sums = np.zeros((size + 1, len(words)), np.uint64)
        for i in range(size):
            sums[i + 1] = sums[i] * ROLL + letters[:, i] + np.uint64(1)
        found, power = {}, np.uint64(1)
        spell = np.zeros((len(words), size), np.float32)
        for n in range(1, min(self.pieces.longest, size) + 1):
            power = np.uint64(int(power) * int(ROLL) % (1 << 64))
            hashes = sums[n:] - sums[:-n] * power
            numbers = self.pieces.find(hashes, self.none)
            if n == 1:
                missing = numbers == self.none
                numbers = np.where(missing, UNSEEN, numbers)
                points = letters.T
                width = 1 + (points > 0x7F).astype(int) + (points > 0x7FF) + (points > 0xFFFF)
                spell = np.where(missing, -width * math.log(256), 0.0).T.astype(np.float32)
            for i in np.flatnonzero((numbers != self.none).any(axis=1)):
                found[int(i), n] = numbers[i]
        return found, spell

    def forward(self, arcs: dict[tuple[int, int], np.ndarray], spell: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of each prefix: [position, word, kind]."""
        n, size = spell.shape
        alpha = np.empty((size + 1, n, self.weights.shape[1]), np.float32)
        alpha[0] = 0.0
        for j in range(1, size + 1):
            terms = [
                alpha[j - k] + self.weights[arcs[j - k, k]] + (spell[:, j - 1, None] if k == 1 else np.float32(0))
                for k in range(1, min(self.pieces.longest, j) + 1)
                if (j - k, k) in arcs
            ]
            alpha[j] = _log_sum(np.stack(terms))
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """[word, kind] natural log of the sum over all segmentations, of words of one length."""
        return self.forward(*self.arcs(words))[-1]

    def expected(self, words: list[str]) -> np.ndarray:
        """The expected number of each piece in the words, under the first kind."""
        arcs, spell = self.arcs(words)
        alpha = self.forward(arcs, spell)[:, :, 0]
        weights = self.weights[:, 0]
        n, size = spell.shape
        beta = np.empty_like(alpha)
        beta[size] = 0.0
        numbers, parts = [], []
        for i in range(size - 1, -1, -1):
            lengths = [k for k in range(1, min(self.pieces.longest, size - i) + 1) if (i, k) in arcs]
            terms = np.stack([beta[i + k] + weights[arcs[i, k]] + (spell[:, i] if k == 1 else np.float32(0)) for k in lengths])
            beta[i] = _log_sum(terms)
            numbers += [arcs[i, k] for k in lengths]
            parts.append(np.exp(terms + (alpha[i] - alpha[size])))
        return np.bincount(np.concatenate(numbers), np.concatenate(parts).ravel(), minlength=len(weights))


def _log_sum(terms: np.ndarray) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def by_length(words: list[str], most: int = 1024) -> Iterator[list[int]]:
    """Places of words of one length, in groups of bounded total length."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    group: list[int] = []
    for i in order:
        if group and (len(words[group[0]]) != len(words[i]) or len(group) * (len(words[i]) + 1) >= most * 16):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


# ------------------------------------------------------------------ kinds of documents


def buckets(data: bytes) -> np.ndarray:
    """The bucket of each pair of neighbouring bytes of the lower-cased text."""
    letters = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    return ((letters[:-1] << 8 | letters[1:]) * np.uint32(40503) & 0xFFFF) >> 5


def fit_kinds(x: np.ndarray, kinds: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mixture of multinomials: log weights [bucket, kind] and log shares [kind]."""
    rng = np.random.default_rng(SEED)
    near = np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True)))
    seeds = [int(rng.integers(len(x)))] if len(x) else []
    while 0 < len(seeds) < min(kinds, len(x)):
        seeds.append(int(np.argmin(np.max(near @ near[seeds].T, axis=1))))
    if not seeds:
        return np.full((BUCKETS, 1), -math.log(BUCKETS)), np.zeros(1)
    belongs = np.eye(len(seeds))[np.argmax(near @ near[seeds].T, axis=1)]
    for _ in range(rounds):
        theta = x.T @ belongs + 0.1
        theta = np.log(theta / theta.sum(axis=0))
        share = np.log((belongs.sum(axis=0) + 1) / (len(x) + belongs.shape[1]))
        score = x @ theta + share
        belongs = np.exp(score - score.max(axis=1, keepdims=True))
        belongs /= belongs.sum(axis=1, keepdims=True)
    return theta, share


def _narrow(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))


def held_out() -> Column:
    return crc_mod("doc_id", 7) == 2


def find_kinds(docs: DataFrame, sample: int = SAMPLE, kinds: int = KINDS) -> tuple[np.ndarray, np.ndarray]:
    order = F.xxhash64(F.lit(SEED), "doc_id")
    ids = _narrow(docs).filter(~held_out()).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    chosen = _narrow(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("data").alias("data"))  # at most `sample` rows
    schema = pa.schema([("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(data: bytes) -> tuple:
            counts = np.bincount(buckets(data), minlength=BUCKETS)
            there = np.flatnonzero(counts)
            return there.tolist(), counts[there].tolist()

        return arrow_rows(batches, schema, row)

    rows = chosen.select("data").mapInArrow(tidy(run), "b array<int>, n array<int>").collect()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(sorted(rows, key=lambda r: (r["b"], r["n"]))):
        x[i, r["b"]] = r["n"]
    return fit_all(docs, *fit_kinds(x, kinds))


def fit_all(docs: DataFrame, theta: np.ndarray, share: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The mixture after rounds over all training documents, until their likelihood stands still; the driver gets sums by bucket."""
    kinds, before = len(share), -math.inf
    data = _narrow(docs).filter(~held_out()).select("data")
    names = [f"s{k}" for k in range(kinds)]
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((theta, share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            theta, share = shared.value
            into = np.zeros((BUCKETS + 2, kinds))
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    x = np.stack([np.bincount(buckets(d), minlength=BUCKETS) for d in batch.column(0).slice(start, 256).to_pylist()]).astype(np.float64)
                    score = x @ theta + share
                    high = score.max(axis=1, keepdims=True)
                    belongs = np.exp(score - high)
                    total = belongs.sum(axis=1, keepdims=True)
                    belongs /= total
                    into[:BUCKETS] += x.T @ belongs
                    into[BUCKETS] += belongs.sum(axis=0)
                    into[BUCKETS + 1, 0] += (high + np.log(total)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(into), dtype=np.int32)), *(pa.array(into[:, k]) for k in range(kinds))], names=["bucket", *names])

        summed = data.mapInArrow(tidy(run), ", ".join(["bucket int", *(f"{n} double" for n in names)])).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
        sums = np.zeros((BUCKETS + 2, kinds))
        for r in summed.collect():  # BUCKETS + 2 rows
            sums[r["bucket"]] = r[1:]
        if not sums[BUCKETS].any():
            break
        theta = np.log((sums[:BUCKETS] + 0.1) / (sums[:BUCKETS] + 0.1).sum(axis=0))
        share = np.log((sums[BUCKETS] + 1) / (sums[BUCKETS].sum() + kinds))
        live = sums[BUCKETS] >= 1
        if not live.all() and live.any():  # kinds without documents go
            return fit_all(docs, theta[:, live], share[live], rounds)
        likelihood = float(sums[BUCKETS + 1, 0])
        if likelihood - before <= STILL * abs(likelihood):
            break
        before = likelihood
    return theta, share


# ------------------------------------------------------------------ counts of all training words


def _texts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Words]]:
    """(rows, bytes, offsets, words) by chunks of bounded size."""
    for batch in batches:
        for at, data, offsets in chunks(batch.column(column)):
            yield batch.slice(at, len(offsets) - 1), data, offsets, words_of(data, offsets)


def kinds_of(data: np.ndarray, offsets: np.ndarray, theta: np.ndarray, share: np.ndarray) -> np.ndarray:
    out = np.empty(len(offsets) - 1, np.int64)
    for start in range(0, len(out), 256):
        at = range(start, min(start + 256, len(out)))
        x = np.stack([np.bincount(buckets(data[offsets[i] : offsets[i + 1]].tobytes()), minlength=BUCKETS) for i in at])
        out[start : start + 256] = np.argmax(x @ theta + share, axis=1)
    return out


def distinct(words: Words, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair of key and word, how often it occurs)."""
    mixed = words.hashes + key.astype(U64) * U64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed, kind="stable")
    first = np.flatnonzero(np.append(True, mixed[order[1:]] != mixed[order[:-1]])) if len(order) else order
    return order[first], np.diff(np.append(first, len(order)))


def count_words(docs: DataFrame, theta: np.ndarray, share: np.ndarray) -> DataFrame:
    """(word, c0, c1, ...): counts by kind over all training documents; the end is the empty word."""
    kinds = len(share)
    schema = pa.schema([("word", pa.binary()), ("kind", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[dict[bytes, int]] = [{} for _ in range(kinds)]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, t in enumerate(tables):
                columns = [pa.array(t.keys(), pa.binary()), pa.array(np.full(len(t), kind, np.int32)), pa.array(t.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                t.clear()

        for _, data, offsets, words in _texts_of(batches, 0):
            kind = kinds_of(data, offsets, theta, share)
            for k, n in enumerate(np.bincount(kind, minlength=kinds).tolist()):
                if n:
                    tables[k][b""] = tables[k].get(b"", 0) + n
            whole = data.tobytes().lower()
            by_word = kind[words.owners()]
            places, counts = distinct(words, by_word)
            for s, e, k, n in zip(words.starts[places].tolist(), words.ends[places].tolist(), by_word[places].tolist(), counts.tolist()):
                table, word = tables[k], whole[s:e]
                table[word] = table.get(word, 0) + n
            if sum(map(len, tables)) >= TABLE_WORDS:
                yield from flush()
        yield from flush()

    partial = _narrow(docs).filter(~held_out()).select("data").mapInArrow(tidy(run), "word binary, kind int, n long")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"c{k}")
    return materialize(partial.groupBy("word").agg(*map(of, range(kinds))), "words")


def _names(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 131_072, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows or bytes: lattices of words of one length are made together."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
        if sum(b.num_rows for b in some) >= rows or sum(b.nbytes for b in some) >= size:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def _columns(batch: pa.RecordBatch, first: int, kinds: int) -> np.ndarray:
    """Numeric columns as [row, kind]; nulls as NaN."""
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(kinds)], axis=1)


def fit_pieces(words: DataFrame, path: str, kinds: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log piece weights [piece, kind] by expectation-maximisation over all distinct training words."""
    first = pieces_of(path).first
    weights = np.repeat(first[:, None], kinds, axis=1)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            pieces = pieces_of(path)
            lattices = [Lattice(pieces, own[:, k : k + 1]) for k in range(kinds)]
            into = np.zeros((len(own) + 1, kinds))
            for batch in gathered(batches):
                names, counts = _names(batch.column(0)), _columns(batch, 1, kinds)
                for k, lattice in enumerate(lattices):
                    # Distinct words, not their repeats: the pieces spell what is rare.
                    mine = [names[i] for i in np.flatnonzero(counts[:, k]) if names[i]]
                    for group in by_length(mine):
                        into[:, k] += lattice.expected([mine[i] for i in group])
            there = np.flatnonzero(into[:-1].any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), *(pa.array(into[there, k]) for k in range(kinds))],
                names=["piece", *(f"e{k}" for k in range(kinds))],
            )

        ddl = ", ".join(["piece int", *(f"e{k} double" for k in range(kinds))])
        summed = words.mapInArrow(tidy(run), ddl).groupBy("piece").agg(*(F.sum(f"e{k}").alias(f"e{k}") for k in range(kinds)))
        expected = np.zeros_like(weights)
        for r in summed.collect():  # at most one row for each piece of the vocabulary
            expected[r["piece"]] = r[1:]
        prior = np.exp(first)[:, None] * (1.0 + 1e-4 * expected.sum(axis=0) + 10.0)
        # Pieces that a kind lacks lean on all kinds together.
        pooled = expected.sum(axis=1, keepdims=True)
        lean = pooled / max(1.0, pooled.sum()) * (1e-2 * expected.sum(axis=0) + 10.0)
        weights = np.log((expected + lean + prior) / (expected + lean + prior).sum(axis=0))
    return weights


# ------------------------------------------------------------------ scoring


class Model:
    """Natural log probabilities by kind of words with counts, and of the end."""

    def __init__(self, path: str, weights: np.ndarray, tokens: np.ndarray, types: np.ndarray, ends: np.ndarray) -> None:
        self.path, self.weights = path, weights
        self.tokens, self.types, self.ends = np.maximum(tokens, 1e-9), types, ends

    def __getstate__(self) -> tuple:
        return self.path, self.weights.astype(np.float32), self.tokens, self.types, self.ends

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @property
    def lattice(self) -> Lattice:
        if "_lattice" not in self.__dict__:
            self._lattice = Lattice(pieces_of(self.path), self.weights)
        return self._lattice

    def words(self, names: list[str], counts: np.ndarray) -> np.ndarray:
        """[word, kind] log of discounted count plus what the discounts free, spread by the lattice."""
        out = np.empty(counts.shape)
        free = np.where(self.types > 0, DISCOUNT * self.types / self.tokens, 1.0)
        for group in by_length(names):
            spelt = self.lattice.log_probability([names[i] for i in group])
            whole = np.maximum(counts[group] - DISCOUNT, 0) / self.tokens
            with np.errstate(divide="ignore"):
                out[group] = np.logaddexp(np.log(whole), np.log(free) + spelt)
        return out

    def end(self) -> np.ndarray:
        return np.log(np.maximum(self.ends - DISCOUNT, 1e-3) / np.maximum(self.tokens, 1.0))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The kernels' hashes of lower-case words."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return words_of(np.frombuffer(b"".join(words), np.uint8), offsets).hashes


def _urn_sizes(most: int) -> np.ndarray:
    """Sums of the log of the urn's size over the first draws."""
    return np.concatenate([[0.0], np.cumsum(np.log(URN + np.arange(most)))])


def repeated(logs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log of an urn's weights over all draws of each word in a text, but for the urn's size: [word, kind]."""
    out = logs + math.log(URN)
    more = np.flatnonzero(times > 1)
    if len(more):
        again = times[more] - 1
        starts = np.cumsum(again) - again
        drawn = np.arange(again.sum()) - np.repeat(starts, again) + 1
        weights = np.repeat(np.exp(out[more]), again, axis=0) + drawn[:, None]
        out[more] += np.add.reduceat(np.log(weights), starts, axis=0)
    return out


def _by_row(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values, in order of owner, for each of so many rows."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    return sums[bounds[1:]] - sums[bounds[:-1]]


@scratched
def score(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    context = docs.sparkSession.sparkContext
    theta, share = find_kinds(docs, SAMPLE, KINDS)
    kinds = len(share)
    words = count_words(docs, theta, share)
    counts = [F.col(f"c{k}") for k in range(kinds)]
    sums = words.agg(
        F.array(*(F.coalesce(F.sum(c), F.lit(0)) for c in counts)).alias("tokens"),
        F.array(*(F.count_if(c > 0) for c in counts)).alias("types"),
        F.array(*(F.coalesce(F.sum(F.when(F.length("word") == 0, c)), F.lit(0)) for c in counts)).alias("ends"),
        F.count(F.lit(1)).alias("all_types"),
    ).collect()[0]
    tokens, types, ends = (np.array(sums[c], np.float64) for c in ("tokens", "types", "ends"))
    n_train, v_train, n_ends = int(tokens.sum()), int(sums["all_types"]), int(ends.sum())
    model = Model(path, fit_pieces(words, path, kinds), tokens, types - (ends > 0), ends)
    key, shared = ("lattice", uuid.uuid4().hex), context.broadcast(model)
    base_of = math.log10(n_train + v_train + 1) if n_train else 0.0

    log_names = [f"l{k}" for k in range(kinds)]
    log_ddl = ", ".join(f"{n} double" for n in log_names)
    float_ddl = ", ".join(f"{n} float" for n in log_names)

    def lexicon_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held(key, lambda: shared.value)
        for batch in gathered(batches):
            counts = _columns(batch, 1, kinds)
            names = batch.column(0).to_pylist()
            logs = mine.words([w.decode("utf-8", "replace") for w in names], counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word_hashes(names).view(np.int64)), pa.array(counts.sum(axis=1).astype(np.int64)), *(pa.array(logs[:, k], pa.float32()) for k in range(kinds))],
                names=["key", "n", *log_names],
            )

    lexicon = words.filter(F.length("word") > 0).mapInArrow(tidy(lexicon_run, key), f"key long, n long, {float_ddl}")
    lexicon = materialize(lexicon, "lexicon")
    top = lexicon.orderBy(F.desc("n"), "key").limit(TIER).toArrow().combine_chunks()
    top_logs = np.stack([top.column(n).to_numpy() for n in log_names], axis=1) if top.num_rows else np.zeros((0, kinds), np.float32)
    places = HashTable(top.column("key").to_numpy().astype(np.int64).view(U64), np.arange(top.num_rows, dtype=np.int32))
    tier = context.broadcast((places, np.append(top.column("n").to_numpy(), 0).astype(np.float64), np.concatenate([top_logs, np.zeros((1, kinds), np.float32)])))
    end_known = 1 if n_ends else 0
    end_base = math.log10(n_ends + 1) - base_of
    end_logs = model.end() + math.log(URN) + np.array([math.log(max(n, 0.5) / max(1.0, n_ends)) for n in ends])

    def partial_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, logs = tier.value
        base = np.log10(counts + 1) - base_of
        row_no = TaskContext.get().partitionId() << 40
        for rows, data, _, words in _texts_of(batches, 2):
            n = rows.num_rows
            owner = words.owners()
            at, times = distinct(words, owner)
            text_by_text = np.argsort(at)
            at, times = at[text_by_text], times[text_by_text]
            where, there = table.find(words.hashes[at])
            known, text = there, owner[at]
            where = np.where(known, where, len(counts) - 1)
            in_tier = np.flatnonzero(known)
            total = np.zeros((n, kinds))
            if len(in_tier):
                total += _by_row(repeated(logs[where[in_tier]].astype(np.float64), times[in_tier]), text[in_tier], n)
            length = words.counts
            total += end_logs - _urn_sizes(int(length.max(initial=0)) + 1)[length + 1][:, None]
            rare = np.flatnonzero(~known)
            bounds = np.searchsorted(text[rare], np.arange(n + 1)).astype(np.int32)
            out = rows.column(1).to_numpy(zero_copy_only=False)
            spelt = [data[words.starts[at[i]] : words.ends[at[i]]].tobytes().lower() if out[text[i]] else None for i in rare.tolist()]
            lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds), values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_no + np.arange(n)), rows.column(0), rows.column(1), pa.array(length + 1),
                    pa.array(_by_row(np.where(known, times, 0), text, n).astype(np.int64) + end_known),
                    pa.array(_by_row(np.where(known, base[where] * times, 0.0), text, n) + end_base),
                    pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), kinds).cast(pa.list_(pa.float64())),
                    lists(pa.array(words.hashes[at[rare]].view(np.int64))), lists(pa.array(times[rare].astype(np.int32))), lists(pa.array(spelt, pa.binary())),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "logs", "keys", "times", "words"],
            )
            row_no += n

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, logs array<double>, keys array<long>, times array<int>, words array<binary>"
    narrow = _narrow(docs).select("doc_id", held_out().alias("held_out"), "data")
    partial = materialize(narrow.mapInArrow(tidy(partial_run), ddl), "partial", compression="zstd")
    rare = partial.select("row", F.inline(F.arrays_zip("keys", "times", "words"))).toDF("row", "key", "times", "word")
    # A key's rows are few: what occurs more often than 1 / TIER of all tokens is in the tier.
    met = rare.join(lexicon, "key", "left").select("row", "word", "times", "n", *log_names)

    def rest_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held(key, lambda: shared.value)
        for batch in gathered(batches):
            rows = batch.column(0).to_numpy()
            times = batch.column(2).to_numpy().astype(np.int64)
            counts = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64))
            logs = _columns(batch, 4, kinds)
            unknown = np.flatnonzero(counts == 0)
            if len(unknown):  # only in held-out documents: spelt by the lattice alone, each distinct word once a batch
                number: dict[bytes, int] = {}
                at = [number.setdefault(w, len(number)) for w in batch.column(1).take(pa.array(unknown)).to_pylist()]
                spelt = mine.words([w.decode("utf-8", "replace") for w in number], np.zeros((len(number), kinds)))
                logs[unknown] = spelt[at]
            order = np.argsort(rows, kind="stable")
            ids, starts = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(repeated(logs, times)[order], starts)
            base = np.add.reduceat(((np.log10(counts + 1) - base_of) * times)[order], starts)
            known = np.add.reduceat(((counts > 0) * times)[order], starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(known), pa.array(base), *(pa.array(total[:, k]) for k in range(kinds))],
                names=["row", "more_known", "more_base", *log_names],
            )

    rest = met.mapInArrow(tidy(rest_run, key), f"row long, more_known long, more_base double, {log_ddl}").groupBy("row").agg(
        F.sum("more_known").alias("more_known"), F.sum("more_base").alias("more_base"), *(F.sum(n).alias(n) for n in log_names)
    )
    both = partial.drop("keys", "times", "words").join(rest, "row", "left")
    by_kind = [F.col("logs")[k] + F.coalesce(F.col(f"l{k}"), F.lit(0.0)) for k in range(kinds)]
    high = F.greatest(*by_kind) if kinds > 1 else by_kind[0]
    total = sum((F.exp(s - high) for s in by_kind[1:]), F.exp(by_kind[0] - high))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        ((high + F.log(total)) / F.lit(math.log(10))).alias("score"),
    )
