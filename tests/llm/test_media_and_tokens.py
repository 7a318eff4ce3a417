from __future__ import annotations

import hashlib
import random
import zlib
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidemark.llm import packing, token_counts, transport_stream, unit_tokens

ODD = ["", "a", None, "same", "same", "x" * 200_000, "é" * 700, "  two  spaces \n\n\t end ", "a<|endoftext|>b <|startoftext|>", "'s 12 ÅΣσ ß ﬁ ́x"]


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 100_000])
def test_transport_stream_round_trip(n):
    payload = transport_stream.pad(bytes(i * 31 % 256 for i in range(n)))
    found = transport_stream.parse(transport_stream.mux(payload))
    assert found.payload == payload and len(payload) % 576 == 0
    assert found.continuity_errors == found.table_errors == 0
    assert found.programs == {1: transport_stream.PMT_PID} and found.streams == {transport_stream.ES_PID: 6}
    assert len(found.timestamps) == len(found.access_points) == -(-len(payload) // (576 * 64))
    assert found.timestamps == found.clocks == sorted(found.timestamps)


def test_transport_stream_finds_damage():
    stream = bytearray(transport_stream.mux(transport_stream.pad(b"x" * 5000)))
    cut = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    assert transport_stream.parse(cut).continuity_errors == 1
    stream[10] ^= 1  # inside the program association section
    assert transport_stream.parse(bytes(stream)).table_errors == 1
    with pytest.raises(ValueError):
        transport_stream.parse(bytes(stream[:100]))


def packet(pid, counter, payload=b"", flags=None, begins=False):
    """A transport packet; flags: of an adaptation field that fills what the payload leaves."""
    room = 184 - len(payload)
    field_ = b"" if not room else bytes([room - 1]) + (bytes([flags or 0]) + b"\xff" * (room - 2) if room > 1 else b"")
    control = (2 if room else 0) | (1 if payload else 0)
    return bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 0xFF, control << 4 | counter]) + field_ + payload


def test_null_repeated_and_announced_packets_are_no_errors():
    payload = transport_stream.pad(bytes(range(256)) * 40)
    stream = transport_stream.mux(payload)
    cut = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    found = transport_stream.parse(b"".join([*cut[:4], null, null, *cut[4:]]))
    assert found.continuity_errors == 0 and found.payload == payload
    found = transport_stream.parse(b"".join([*cut[:6], cut[5], *cut[6:]]))
    assert found.continuity_errors == 0 and found.payload == payload
    found = transport_stream.parse(b"".join([*cut[:6], cut[5], cut[5], *cut[6:]]))
    assert found.continuity_errors == 1
    alone = packet(transport_stream.ES_PID, cut[5][3] & 15)  # without payload: does not count on
    found = transport_stream.parse(b"".join([*cut[:6], alone, *cut[6:]]))
    assert found.continuity_errors == 0 and found.payload == payload
    jump = packet(transport_stream.ES_PID, 9, b"", flags=0x80)
    again = packet(transport_stream.ES_PID, 10, b"\x00" * 180)
    assert transport_stream.parse(b"".join([*cut, jump, again])).continuity_errors == 0
    assert transport_stream.parse(b"".join([*cut, packet(transport_stream.ES_PID, (cut[-1][3] + 5) & 15, b"x" * 184)])).continuity_errors == 1


def test_sections_over_several_packets():
    streams = b"".join(bytes([6, 0xE1, i, 0xF0, 0]) for i in range(60))
    pmt = transport_stream._section(bytes([0, 1, 0xC1, 0, 0, 0xE1, 0, 0xF0, 0]) + streams, 2)
    pat = transport_stream._section(bytes([0, 1, 0xC1, 0, 0, 0, 1, 0xF0, 0]), 0)
    whole = b"\x00" + pmt
    media = packet(0, 0, b"\x00" + pat, begins=True) + packet(0x1000, 0, whole[:184], begins=True)
    # The rest ends where a pointer says that the next section begins.
    rest = whole[184:]
    media += packet(0x1000, 1, bytes([len(rest)]) + rest + pat[:10], begins=True)
    found = transport_stream.parse(media)
    assert sorted(found.streams) == [0x100 + i for i in range(60)] and found.table_errors == 0 and found.continuity_errors == 0


def test_media_query_against_plain_python(spark):
    docs = documents(spark, ODD).withColumns({"media": F.lit(1), "feature": F.lit("clash")})
    lost = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.doc_id for r in transport_stream.media_features(lost).collect()] == [None]
    rows = {r.doc_id: r for r in transport_stream.media_features(docs).collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes % 188 == 0
    assert rows[3].media_sha256 == rows[4].media_sha256 and rows[3].feature == rows[4].feature
    assert transport_stream.probe(transport_stream.to_media(docs.limit(0))).collect() == []


def random_texts(n):
    rng = random.Random(5)
    signs = [" ", "  ", "\n", "a", "bé", "The", "12", "!", "\t", "<|endoftext|>", "<|startoftext|>", "'s", "Σ", "é", "́", "ß", "日本", "😀", "\r\n", "\x1c", " "]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_and_counts_are_the_librarys():
    ids = unit_tokens.TextIds(str(public_tokenizers.path("byte_bpe_50k.json")))
    counts = unit_tokens.UnitCounts(str(public_tokenizers.path("word_bpe_49k.json")), {})
    for text in [t for t in ODD if t is not None] + random_texts(4000):
        assert ids(text) == array("I", ids.tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), text
        assert counts(text) == len(counts.tokenizer.encode(text, add_special_tokens=False)), text


def test_token_counts(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = unit_tokens.load_tokenizer(path)
    texts = ODD + ["the cat " * 3000]
    docs = documents(spark, texts).withColumns({"n_bytes": F.lit("clash"), "n_tokens": F.lit("clash")}).repartition(3)
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, path).collect()}
    for i, text in enumerate(texts):
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(docs.limit(0), path).collect() == []
    assert token_counts.frequent_pre_tokens(docs)[:2] == ["cat", "the"]


def check_packed(rows, texts, capacity=1024):
    tokenizer = unit_tokens.load_tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == capacity for p in parts[1:])
        at = 0
        for p in parts:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids) and (len(parts) == 1 or len(ids) > capacity)
    for parts in by_bin.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_bin)


def plain_best_fit(lengths, capacity):
    """Bins of the same rules, one piece at a time: pairs of large pieces, then the fullest bin that still holds a small one."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        mate = next((m for m in large if m <= capacity - n), None)
        if mate is not None:
            large.remove(mate)
        gaps.append(capacity - n - (mate or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing(spark):
    rng = random.Random(3)
    texts = ODD + ["w " * rng.choice([3, 40, 200, 340, 341, 342, 500, 511, 700, 1023, 1500]) for _ in range(200)]
    docs = documents(spark, texts).repartition(4)
    rows = packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    bins = check_packed(rows, texts)
    assert bins <= plain_best_fit([r.length for r in rows], 1024)
    assert bins <= 1.03 * sum(r.length for r in rows) / 1024 + 20
    assert packing.pack(docs.limit(0), str(public_tokenizers.path("byte_bpe_50k.json"))).collect() == []


def test_plan_places_every_piece_once():
    rng = random.Random(9)
    for _ in range(50):
        counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(rng.randint(1, 40))}
        plan = packing.plan_bins(counts, 100)
        held = {}
        for pattern, bins in plan:
            assert bins > 0 and sum(n * c for n, c in pattern) <= 100
            assert sum(c for n, c in pattern if 3 * n > 100) <= 2
            for n, c in pattern:
                held[n] = held.get(n, 0) + c * bins
        assert held == counts
        covered = {}
        for length, low, high, _, _ in packing.slots(plan):
            assert covered.get(length, 0) == low
            covered[length] = high
        assert covered == counts
