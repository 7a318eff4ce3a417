"""N-gram Jaccard join by PartEnum signatures, and the components it makes.

A document's features are its distinct word shingles as 48-bit hashes. Sets of one size band whose
similarity reaches the threshold differ in at most k features, k fixed by the band. The feature
domain is dealt into first-level partitions, of which one has at most one difference, and each of
them into second-level cells; every subset of cells with one cell left out is a signature (three cells
to a partition, so three subsets of two). So two similar sets of a band share at least one signature,
and overlapping bands cover all sizes.

Equal sets are one node, so exact copies cost one row from each task. Of a signature's nodes the
smallest is the hub, and only (hub, node) pairs are made, never all pairs of a group. A cluster is a
hub with its nodes; first it falls into the parts that 256-byte parity sketches leave together (a
link between parts is ruled out exactly), then, as those say nothing of long sets, into the parts that sketches
of a bit a feature leave; only nodes of parts of several get their sets moved.
Inside a cluster the sketch-near pairs that are not joined yet are compared by their whole sets, so all
similar pairs count exactly, also those that miss the hub. Clusters
too large for one task are split: each node is compared with the hub alone, and goes on to smaller
clusters by the features in which it differs from the hub (a prefix of them that any other similar
node must share, or both are similar to the hub). No links, components or sets reach the driver.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle; repeated rows are one node and share its component; ties cannot
arise, as components are named by their smallest doc_id; a null doc_id never names one; a long text
is worked on alone, with memory in proportion to it; an empty table gives an empty table; columns
besides doc_id and text are not read by `components`, and are carried by `keep_one`, whose working
columns take names that they lack. Features and nodes are hashes of 48 and 64 bits: different ones are taken for
equal with probability about 1e-9 for a pair of documents of 1000 words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, materialize, scratch, tidy, tidy_group, unused
from tidemark.llm.kernels import U64, Words, chunks, mix, words_of

#: Nodes and features of a cluster that one task takes.
CLUSTER_NODES = 20_000
CLUSTER_FEATURES = 4_000_000
#: Nodes that a task remembers to have made signatures of.
SEEN_NODES = 100_000
#: Candidate nodes up to which their ids are broadcast to filter the sets (16 bytes each); beyond, a shuffle join.
BROADCAST_NODES = 1_000_000


@dataclass(frozen=True)
class Likeness:
    """Linked when per_union * intersection >= per_inter * union, over shingles of `words` words."""

    words: int = 3
    per_inter: int = 90
    per_union: int = 100
    #: Second-level cells of a first-level partition; a signature is all of them but one.
    cells: int = 3
    #: Largest over smallest size of a band.
    spread: float = 1.5
    #: First-level partitions beyond the fewest that the differences ask for, as a share of them.
    spare: float = 0.1

    def linked(self, a: np.ndarray | int, b: np.ndarray | int, both: np.ndarray | int):
        return self.per_union * both >= self.per_inter * (a + b - both)

    def differences(self, size: int) -> int:
        """The most features in which two linked sets of at most size features differ."""
        return 2 * size * (self.per_union - self.per_inter) // (self.per_union + self.per_inter)

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(number, largest size) of the bands that size is in."""
        low, number, found = 1, 0, []
        while low <= size:
            high = max(low, int(low * self.spread))
            if size <= high:
                found.append((number, high))
            low = max(low + 1, -(-self.per_inter * (high + 1) // self.per_union))
            number += 1
        return found


#: An odd multiplier for each place of a shingle, from one rule.
_PLACES = mix(np.arange(1, 65, dtype=U64)) | U64(1)


@dataclass
class Sets:
    """The feature sets of some texts: sorted distinct 48-bit hashes, and where each text's begin."""

    features: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.sizes)

    def take(self, rows: np.ndarray) -> Sets:
        sizes = self.sizes[rows]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[rows], sizes)
        return Sets(self.features[at], bounds)

    def nodes(self) -> np.ndarray:
        """A 64-bit hash of each set."""
        sums = np.zeros(len(self.features) + 1, U64)
        np.cumsum(mix(self.features * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019)), out=sums[1:])
        return mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + mix(self.sizes.astype(U64))).view(np.int64)

    def sketches(self) -> np.ndarray:
        """Two sets' sketches differ in no more bits than the sets in features, so a far sketch rules a link out."""
        rows = len(self.bounds) - 1
        at = self.owners() * SKETCH_BITS + (mix(self.features) % U64(SKETCH_BITS)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8).reshape(rows, SKETCH_BITS), axis=1)

    def wide_sketches(self) -> list[bytes]:
        """Sketches of at least as many bits as a set has features: a long set's tell more than SKETCH_BITS can."""
        found = [b""] * len(self.sizes)
        bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(np.int64))
        for width in np.unique(bits).tolist():
            alike = np.flatnonzero(bits == width)
            step = max(1, (1 << 20) // width)  # counts of 8 MB at once
            for rows in np.split(alike, range(step, len(alike), step)):
                own = self.take(rows)
                at = own.owners() * width + (mix(own.features) % U64(width)).astype(np.int64)
                packed = np.packbits((np.bincount(at, minlength=len(rows) * width) & 1).astype(np.uint8).reshape(len(rows), width), axis=1)
                for row, one in zip(rows.tolist(), packed):
                    found[row] = one.tobytes()
        return found

    def stored(self) -> pa.Array:
        """Each set as binary, six bytes a feature."""
        return binaries(self.features.view(np.uint8).reshape(-1, 8)[:, :6], 6 * self.bounds)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def from_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(U64)


def shingle_sets(words: Words, size: int) -> Sets:
    """The distinct shingles of each text; a text of fewer words is one shingle."""
    hashes, owners, counts = words.hashes, words.owners(), words.counts
    n = len(hashes) - size + 1
    keys = []
    if n > 0:
        total = np.zeros(n, U64)
        for i in range(size):
            total += hashes[i : i + n] * _PLACES[i]
        whole = np.flatnonzero(owners[:n] == owners[size - 1 :])
        keys.append(owners[whole].astype(U64) << U64(48) | mix(total[whole]) >> U64(16))
    for few in range(1, size):
        rows = np.flatnonzero(counts == few)
        total = np.full(len(rows), few, U64)
        for i in range(few):
            total += hashes[words.bounds[rows] + i] * _PLACES[8 + i]
        keys.append(rows.astype(U64) << U64(48) | mix(total) >> U64(16))
    found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, U64)
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    bounds = np.searchsorted(found, np.arange(len(counts) + 1, dtype=U64) << U64(48))
    return Sets(found & U64((1 << 48) - 1), bounds)


def shingles(data: bytes, words: int) -> np.ndarray:
    """The sorted features of one text."""
    whole = np.frombuffer(data, np.uint8)
    return shingle_sets(words_of(whole, np.array([0, len(whole)])), words).features


#: A signature of fewer features says nothing: such are left out where that loses no link.
LIGHT = 1
#: Bits left out of a shuffled signature: 40 stay. Equal signatures stay equal, and pairs met by chance are compared as all are.
SIG_CUT = 24
#: Bits of a node's sketch: the parity of its features in each of so many buckets.
SKETCH_BITS = 2_048
#: Bits of the folded sketch that is compared first.
FOLDED_BITS = 512


@functools.lru_cache(100_000)
def _bands(like: Likeness, size: int) -> list[tuple[int, int]]:
    return like.bands(size)


def signatures(sets: Sets, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set): PartEnum signatures of the sets, in all bands of their sizes.

    Of a band's `parts` first-level partitions at least parts - k // 2 hold at most one of two linked
    sets' k differences, and there all cells but one are equal: that subset of cells is a shared signature.
    A subset without features says nothing. Where fewer partitions than those have such a subset, a
    partition without one is among them, and the set's empty subsets are left out. With two cells a
    subset is one cell, and equal cells are counted instead: at least 2 * parts - k.
    """
    in_band: dict[tuple[int, int], list[int]] = {}
    for row, size in enumerate(sets.sizes.tolist()):
        for band in _bands(like, size) if size else ():
            in_band.setdefault(band, []).append(row)
    made, owners = [], []
    for (number, high), rows in in_band.items():
        k = like.differences(high)
        if not k:
            continue  # only equal sets are linked here, and they are one node
        parts = -(-int((k + 1) * (1 + like.spare) + 1) // 2)
        own = sets.take(np.array(rows))
        shape = (len(rows), parts, like.cells)
        scattered = mix(own.features + U64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        cell = own.owners() * (parts * like.cells) + (scattered % U64(parts * like.cells)).astype(np.int64)
        sums = np.zeros(len(rows) * parts * like.cells, U64)
        np.add.at(sums, cell, mix(scattered))
        sums = sums.reshape(shape)
        sizes = np.bincount(cell, minlength=sums.size).reshape(shape)
        tags = mix((np.arange(parts, dtype=U64)[:, None] << U64(20)) + U64(number << 8) + np.arange(1, like.cells + 1, dtype=U64))
        subsets = mix(sums.sum(axis=2, dtype=U64)[:, :, None] - sums + mix(tags))  # all cells but one
        light = sizes.sum(axis=2)[:, :, None] - sizes < LIGHT
        if like.cells == 2:
            spared = light.sum(axis=(1, 2)) <= parts * 2 - k - 1
        else:
            spared = light.any(axis=2).sum(axis=1) <= parts - k // 2 - 1
        kept = ~(light & spared[:, None, None])
        made.append(subsets[kept])
        owners.append(np.broadcast_to(np.array(rows)[:, None, None], shape)[kept])
    if not made:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(made), np.concatenate(owners)


_IDS_DDL = "_key long, doc_id long, n long, node long, sketch binary"
_FEATURES_DDL = "node long, n long, features binary, wide binary"


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, data): sets are made from the texts wherever they are needed, and are nowhere stored for all."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, text).alias("_key"), doc_id.alias("doc_id"), text.cast("binary").alias("data"))


def _sets_of_chunks(column: pa.Array, like: Likeness) -> Iterator[tuple[int, Sets]]:
    for at, data, offsets in chunks(column):
        yield at, shingle_sets(words_of(data, offsets), like.words)


def shingle_ids(texts: DataFrame, like: Likeness) -> DataFrame:
    """(_key, doc_id, n, node, sketch): a document's number of shingles and the hash of its set; null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets_of_chunks(batch.column(2), like):
                sizes = sets.sizes
                rows = batch.slice(at, len(sizes))
                empty = pa.array(sizes == 0)
                sketches = binaries(sets.sketches(), np.arange(len(sizes) + 1) * (SKETCH_BITS // 8))
                none = pa.scalar(None, pa.int64()), pa.scalar(None, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(sizes), pa.compute.if_else(empty, none[0], pa.array(sets.nodes())), pa.compute.if_else(empty, none[1], sketches)],
                    names=["_key", "doc_id", "n", "node", "sketch"],
                )

    return texts.select("_key", "doc_id", "data").mapInArrow(tidy(run), _IDS_DDL)


def _signature_rows(texts: DataFrame, like: Likeness) -> DataFrame:
    """(sig, node): a node once from each task, unless it has seen very many others since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, sets in _sets_of_chunks(batch.column(0), like):
                nodes = sets.nodes()
                fresh = np.unique(nodes, return_index=True)[1]
                fresh = fresh[(sets.sizes[fresh] > 0) & ~np.isin(nodes[fresh], seen)]
                seen = np.concatenate([seen if len(seen) < SEEN_NODES else seen[:0], nodes[fresh]])
                own = sets.take(fresh)
                found, owners = signatures(own, like)
                # A set's signatures are distinct but for chance; what repeats is grouped away.
                for start in range(0, len(found), 1 << 18):
                    rows = owners[start : start + (1 << 18)]
                    short = found[start : start + (1 << 18)] >> U64(SIG_CUT)
                    yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64)), pa.array(nodes[fresh][rows])], names=["sig", "node"])

    return texts.select("data").mapInArrow(tidy(run), "sig long, node long")


def _features_of(texts: DataFrame, ids: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """(node, n, features, wide sketch) of the given nodes, each from one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets_of_chunks(batch.column(1), like):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets.sizes)), pa.array(sets.sizes), sets.stored(), pa.array(sets.wide_sketches(), pa.binary())], names=["node", "n", "features", "wide"])

    one = materialize(ids.join(nodes, "node").groupBy("node").agg(F.min("_key").alias("_key")), "one")
    one = F.broadcast(one) if one.count() <= BROADCAST_NODES else one
    met = texts.select("_key", "data").join(one, "_key").select("node", F.coalesce("data", F.lit(b"")).alias("data"))
    found = materialize(met.mapInArrow(tidy(run), _FEATURES_DDL), "candidates")
    if found.count() == one.count():
        return found
    return materialize(found.dropDuplicates(["node"]), "candidates")  # rows that are listed more than once


def _pairs(rows: DataFrame) -> DataFrame:
    """(hub, node) of signatures with several nodes, from rows (sig, node); if some have open, groups without an open node are left out.

    One shuffle serves the minimum and the join back to it. Either only streams a signature's rows.
    """
    # The filter is what the join would infer for one side only; with it, both sides are one exchange.
    dealt = rows.filter("sig is not null and node is not null").repartition(F.col("sig"))
    is_open = F.max("open") if "open" in rows.columns else F.lit(True)
    hubs = dealt.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last"), is_open.alias("any_open"))
    hubs = hubs.filter("hub != last and any_open").select(F.col("sig").alias("s"), "hub")
    joined = dealt.join(hubs.hint("shuffle_hash"), dealt["sig"] == hubs["s"])
    return joined.filter("hub != node").select("hub", "node").distinct()


class Sketches:
    """Packed sketches of some sets, whole and folded to FOLDED_BITS (parities of unions of buckets)."""

    def __init__(self, packed: np.ndarray, sizes: np.ndarray) -> None:
        self.whole = np.ascontiguousarray(packed).view(U64).reshape(len(sizes), SKETCH_BITS // 64)
        self.folded = np.ascontiguousarray(np.bitwise_xor.reduce(self.whole.reshape(len(sizes), -1, FOLDED_BITS // 64), axis=1).T)
        self.sizes = sizes

    def near(self, rows: np.ndarray, others: np.ndarray, like: Likeness) -> np.ndarray:
        """[row, other] whether sizes and sketches allow a link."""
        a, b = self.sizes[rows][:, None], self.sizes[others]
        most = (a + b) * (like.per_union - like.per_inter) // (like.per_union + like.per_inter)
        apart = np.zeros((len(rows), len(others)), np.uint16)
        for word in self.folded:
            apart += np.bitwise_count(word[rows][:, None] ^ word[others])
        near = (apart <= most) & like.linked(a, b, np.minimum(a, b))
        i, j = np.nonzero(near)
        for start in range(0, len(i), 1 << 16):
            at = slice(start, start + (1 << 16))
            apart = np.bitwise_count(self.whole[rows[i[at]]] ^ self.whole[others[j[at]]]).sum(axis=1, dtype=np.int64)
            near[i[at], j[at]] = apart <= most[i[at], j[at]]
        return near


class WideSketches:
    """Sketches of several widths, each a power of two; of two sets the wider one is folded to the other's width."""

    def __init__(self, stored: list[bytes], sizes: np.ndarray) -> None:
        self.sizes, self.width, self.place = sizes, np.array([len(one) for one in stored]), np.zeros(len(sizes), np.int64)
        self.packed: dict[tuple[int, int], np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == width)
            self.place[rows] = np.arange(len(rows))
            self.packed[width, width] = np.frombuffer(b"".join(stored[row] for row in rows.tolist()), U64).reshape(len(rows), -1)

    def _folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.packed:
            whole = self.packed[width, width]
            self.packed[width, to] = np.bitwise_xor.reduce(whole.reshape(len(whole), width // to, to // 8), axis=1)
        return self.packed[width, to]

    def near(self, rows: np.ndarray, others: np.ndarray, like: Likeness) -> np.ndarray:
        """[row, other] whether sizes and sketches allow a link."""
        a, b = self.sizes[rows][:, None], self.sizes[others]
        most = (a + b) * (like.per_union - like.per_inter) // (like.per_union + like.per_inter)
        near = like.linked(a, b, np.minimum(a, b))
        for i, row in enumerate(rows):
            own = int(self.width[row])
            for width in np.unique(self.width[others[near[i]]]).tolist():
                met, to = np.flatnonzero(near[i] & (self.width[others] == width)), min(own, width)
                mine, theirs = self._folded(own, to)[self.place[row]], self._folded(width, to)
                step = max(1, (1 << 20) // to)  # a block of about a megabyte
                for start in range(0, len(met), step):
                    at = met[start : start + step]
                    apart = np.bitwise_count(mine ^ theirs[self.place[others[at]]]).sum(axis=1, dtype=np.int64)
                    near[i, at] = apart <= most[i, at]
        return near


def cluster_links(sets: Sets, like: Likeness) -> np.ndarray:
    """The first set of each set's component, over all similar pairs of a cluster.

    Pairs already in one component are not compared, nor those that sizes or sketches rule out.
    """
    sizes = sets.sizes
    sketches = Sketches(sets.sketches(), sizes)
    label = np.arange(len(sizes))
    for start in range(0, len(sizes), 64):
        block = np.arange(start, min(start + 64, len(sizes)))
        # A component's sets are left out for those rows alone that are in it; the block's other rows may link with them.
        names, rows_in = np.unique(label[block], return_counts=True)
        most = names[rows_in.argmax()]
        inside = label[block] == most
        later = np.arange(start, len(sizes))
        for rows, others in ((block[inside], later[label[later] != most]), (block[~inside], later)):
            near = sketches.near(rows, others, like)
            for i, row in zip(rows, near):
                open_sets = others[row]
                open_sets = open_sets[(open_sets > i) & (label[open_sets] != label[i])]
                if not len(open_sets):
                    continue
                own, theirs = sets.features[sets.bounds[i] : sets.bounds[i + 1]], sets.take(open_sets)
                at = np.minimum(np.searchsorted(own, theirs.features), len(own) - 1)
                both = np.bincount(theirs.owners(), own[at] == theirs.features, minlength=len(open_sets))
                linked = open_sets[like.linked(len(own), theirs.sizes, both)]
                if len(linked):
                    joined = np.isin(label, np.append(label[linked], label[i]))
                    label[joined] = label[joined].min()
    return label


def sketch_parts(sketches: Sketches | WideSketches, like: Likeness) -> np.ndarray:
    """Component of each set when all pairs are joined whose sketches allow a link."""
    part = np.full(len(sketches.sizes), -1)
    for start in range(len(part)):
        if part[start] >= 0:
            continue
        part[start], queue = start, [start]
        while queue:
            rows = np.array(queue[:64])
            queue = queue[64:]
            open_sets = np.flatnonzero(part < 0)
            if not len(open_sets):
                break
            met = open_sets[sketches.near(rows, open_sets, like).any(axis=0)]
            part[met] = start
            queue += met.tolist()
    return part


def _narrow_clusters(like: Likeness, wide: bool = False):
    """A cluster's (hub, node, n, sketch) -> (hub, node) of the parts that sketches leave together, hubs named anew."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.group_by(["node"]).aggregate([("n", "min"), ("sketch", "min")]).sort_by("node")
        nodes, sizes, stored = rows.column("node").to_numpy(), rows.column("n_min").to_numpy(), rows.column("sketch_min").to_pylist()
        part = sketch_parts(WideSketches(stored, sizes) if wide else Sketches(np.frombuffer(b"".join(stored), np.uint8), sizes), like)
        kept = part != np.arange(len(nodes))  # a part's first node is its hub
        return pa.table([pa.array(nodes[part[kept]]), pa.array(nodes[kept])], names=["hub", "node"])

    return run


_EDGES_DDL = "a long, b long"


def _solve(like: Likeness):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(["node", "features"]).sort_by("node").combine_chunks()
        nodes, stored = rows.column("node").to_numpy(), rows.column("features").to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(one) // 6 for one in stored])])
        label = cluster_links(Sets(from_bytes(b"".join(stored)), bounds), like)
        joined = label != np.arange(len(label))
        return pa.table([pa.array(nodes[label[joined]]), pa.array(nodes[joined])], names=["a", "b"])

    return run


def _split_rows(like: Likeness):
    """Rows (hub, node, hub_features, features) -> (hub, node, linked, sigs) of clusters that are too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hub", pa.int64()), ("node", pa.int64()), ("linked", pa.bool_()), ("sigs", pa.list_(pa.int64()))])

        def row(hub: int, node: int, hub_stored: bytes, stored: bytes) -> tuple:
            a, b = from_bytes(hub_stored), from_bytes(stored)
            lacks, extra = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
            linked = bool(like.linked(len(a), len(b), len(b) - len(extra)))
            # Any linked set differs from this one in at most so many features; what the hub lacks is rarer.
            most = like.differences(len(b) * like.per_union // like.per_inter + 1)
            prefix = np.concatenate([extra, lacks])[: most + 1]
            sigs = mix(mix(prefix) + U64(hub * 0x9E3779B97F4A7C15 % (1 << 64)))
            return hub, node, linked, sigs.view(np.int64).tolist()

        return arrow_rows(batches, schema, row)

    return run


def _weighed(pairs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs with `large`, and (hub, large): whether a cluster is more than a task takes."""
    weights = (
        pairs.join(found.select("node", "n"), "node")
        .groupBy("hub")
        .agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("features_in"))
        .withColumn("large", (F.col("nodes") > CLUSTER_NODES) | (F.col("features_in") > CLUSTER_FEATURES))
    )
    weights = materialize(weights.select("hub", "large"), "weights")
    return pairs.join(weights, "hub"), weights


def _with_hubs(dealt: DataFrame, weights: DataFrame) -> DataFrame:
    """(hub, node) of the clusters that a task takes, each hub a node of its own."""
    small = dealt.filter("not large").select("hub", "node")
    return small.union(weights.filter("not large").select("hub", F.col("hub").alias("node")))


def links(texts: DataFrame, ids: DataFrame, like: Likeness) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all linked pairs."""
    edges = []
    rows = _signature_rows(texts, like)
    while True:
        pairs = materialize(_pairs(rows), "pairs")
        sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("nodes"))
        few = materialize(pairs.join(sizes, "hub").withColumn("few", F.col("nodes") <= CLUSTER_NODES).select("hub", "node", "few"), "sized")
        sketches = ids.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        members = few.filter("few").select("hub", "node")
        members = members.union(members.select("hub", F.col("hub")).distinct()).join(sketches, "node")
        near = members.groupBy("hub").applyInArrow(tidy_group(_narrow_clusters(like)), "hub long, node long").distinct()
        pairs = materialize(near.union(few.filter("not few").select("hub", "node")), "near")
        found = _features_of(texts, ids, pairs.select("node").union(pairs.select("hub")).distinct(), like)
        # Long sets are beyond the short sketches; by wide ones the rest of chance goes before whole sets are moved.
        dealt, weights = _weighed(pairs, found)
        members = _with_hubs(dealt, weights).join(found.select("node", "n", F.col("wide").alias("sketch")), "node")
        near = members.groupBy("hub").applyInArrow(tidy_group(_narrow_clusters(like, wide=True)), "hub long, node long").distinct()
        pairs = materialize(near.union(dealt.filter("large").select("hub", "node")).distinct(), "narrow")
        dealt, weights = _weighed(pairs, found)
        with_hub = _with_hubs(dealt, weights)
        needed = materialize(with_hub.select("node").distinct(), "needed")
        needed = F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed
        moved = found.select("node", "features").join(needed, "node", "left_semi")
        edges.append(
            materialize(with_hub.join(moved, "node").groupBy("hub").applyInArrow(tidy_group(_solve(like)), _EDGES_DDL), "links")
        )
        if weights.filter("large").isEmpty():
            break
        hub_sets = found.select(F.col("node").alias("hub"), F.col("features").alias("hub_features"))
        large = dealt.filter("large").select("hub", "node").join(found.select("node", "features"), "node").join(hub_sets, "hub")
        split = materialize(
            large.select("hub", "node", "hub_features", "features").mapInArrow(
                tidy(_split_rows(like)), "hub long, node long, linked boolean, sigs array<long>"
            ),
            "split",
        )
        edges.append(split.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rows = split.select(F.explode("sigs").alias("sig"), "node", (~F.col("linked")).alias("open"))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(edges) > 1 else out


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge: smallest labels spread along edges, with shortcuts, to a fixed point."""
    both = materialize(edges.union(edges.select("b", "a")).toDF("node", "other").filter("node != other").distinct(), "edges")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    labels = materialize(labels, "labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("root").alias("their_root"))
        near = both.join(theirs, "other").groupBy("node").agg(F.min("their_root").alias("near"))
        step = labels.join(near, "node").withColumn("low", F.least("root", "near")).select("node", "root", "low")
        ahead = labels.select(F.col("node").alias("low"), F.col("root").alias("ahead"))
        jumped = step.join(ahead.hint("merge"), "low", "left").select("node", F.col("root").alias("was"), F.least("low", "ahead").alias("root"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("was != root").isEmpty():
            return labels


def components(docs: DataFrame, like: Likeness) -> DataFrame:
    """(_key, doc_id, n_shingles, node, component_id) of each document."""
    texts = keyed_texts(docs)
    with scratch(docs.sparkSession):
        ids = materialize(shingle_ids(texts, like), "ids", keep=True)
        roots = connected(links(texts, ids, like))
        nodes = ids.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"))
        rooted = nodes.join(roots, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
        named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        by_node = materialize(rooted.join(named.hint("merge"), "root").select("node", "component_id"), "components", keep=True)
    # A node may hold a third of all rows: only the sort-merge join of two plain shuffles is split where it is skewed.
    return ids.join(by_node.hint("merge"), "node", "left").select(
        "_key",
        "doc_id",
        F.col("n").alias("n_shingles"),
        "node",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, like: Likeness) -> DataFrame:
    """docs with one document of each component: the one of smallest (doc_id, hash); texts without shingles all stay."""
    key, = unused(docs, "_key")
    with scratch(docs.sparkSession):
        found = materialize(components(docs, like).select("_key", "doc_id", "node", "component_id"), "found")
        first = found.filter("node is not null").groupBy("component_id").agg(
            F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.col("_key"))).alias("first"), F.count(F.lit(1)).alias("rows")
        )
        grouped = first.filter("rows > 1").select("component_id", F.col("first._key").alias("first_key"))
        in_groups = found.filter("node is not null").join(grouped.hint("merge"), "component_id")
        gone = materialize(in_groups.filter("_key != first_key").select(F.col("_key").alias(key)).distinct(), "gone", keep=True)
        listed = in_groups.filter("_key = first_key").groupBy(F.col("_key").alias(key)).agg(F.count(F.lit(1)).alias("rows"))
        twice = materialize(listed.filter("rows > 1").select(key), "twice", keep=True)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = keyed.join(gone, key, "left_anti")
    if twice.isEmpty():
        return kept.drop(key)
    once = kept.join(twice, key, "left_anti")
    return once.unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key])).drop(key)
