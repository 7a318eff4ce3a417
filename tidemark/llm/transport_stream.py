"""MPEG transport streams as a media column.

`mux` wraps a payload in PES packets of a private stream inside 188-byte transport packets with
program tables, continuity counters, clock references and random-access flags. `parse` reads
any such stream back: program tables, also over several packets (checksums verified); continuity
per packet, where null packets have none, a packet may be sent twice, packets without payload do not
count on and a discontinuity may be announced; the reassembled elementary payload; and each PES
packet's timestamp with its random-access point. `store` writes a table's streams to the shared
folder, `probe` reads them back from there.

Defined results: a null or empty text is one unit of fill bytes; a null doc_id stays null; repeated
rows give repeated results; ties cannot arise, as each row stands alone; an empty table gives an empty
table; only `doc_id` and `text` are read, so other columns never clash. Texts of any length are handled
row by row, with memory for a few copies of one text.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import BATCH_BYTES, arrow_rows, materialize, scratch, tidy

PACKET = 188
UNIT = 576
UNITS_PER_PES = 64
NULL_PID = 0x1FFF
PMT_PID = 0x1000
ES_PID = 0x0100
PRIVATE_STREAM = 0xBD
PRIVATE_PES_TYPE = 0x06
#: 90 kHz ticks from one access unit to the next.
TICKS_PER_UNIT = 1800
FIRST_PTS = 90_000


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = ((value << 1) ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        table.append(value)
    return table


_CRC = _crc_table()


@functools.lru_cache(256)
def section_crc(data: bytes) -> int:
    """0 for a whole section with its checksum."""
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(body: bytes, table_id: int) -> bytes:
    length = len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = np.full(PACKET, 0xFF, np.uint8)
    head = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    packet[: len(head)] = np.frombuffer(head, np.uint8)
    return packet


_PAT = _table_packet(0, _section(bytes([0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]), 0))
_PMT = _table_packet(
    PMT_PID,
    _section(
        bytes([0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0])
        + bytes([PRIVATE_PES_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]),
        2,
    ),
)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Fill with bytes 255 up to a positive multiple of unit."""
    units = max(1, -(-len(data) // unit))
    return data.ljust(units * unit, b"\xff")


def _pts_field(pts: int) -> bytes:
    return bytes(
        [0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 0x01 | (pts >> 14) & 0xFE, pts >> 7 & 0xFF, 0x01 | (pts << 1) & 0xFE]
    )


def _pes_packets(data: bytes, pts: int, counter: int) -> np.ndarray:
    """Transport packets of one PES packet, the first a random-access point with a clock reference."""
    head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big")
    pes = np.frombuffer(head + b"\x84\x80\x05" + _pts_field(pts) + data, np.uint8)
    body = pes[176:]
    full, rest = divmod(len(body), 184)
    n = 1 + full + (rest > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = 0x47
    out[:, 1] = ES_PID >> 8
    out[:, 2] = ES_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    base = pts  # the 27 MHz extension is 0
    clock = bytes([base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0])
    out[0, 4:12] = np.frombuffer(bytes([7, 0x50]) + clock, np.uint8)
    out[0, 12:] = pes[:176]
    out[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
    if rest:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - rest
        if rest < 183:
            out[-1, 5] = 0
        out[-1, PACKET - rest :] = body[full * 184 :]
    return out


def mux(payload: bytes, units_per_pes: int = UNITS_PER_PES) -> bytes:
    """A transport stream that holds payload, whose length is a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive number of whole units")
    step = UNIT * units_per_pes
    parts, counter = [], 0
    for k, start in enumerate(range(0, len(payload), step)):
        for packet in (_PAT, _PMT):
            one = packet.copy()
            one[3] |= k & 15
            parts.append(one[None])
        es = _pes_packets(payload[start : start + step], FIRST_PTS + start // UNIT * TICKS_PER_UNIT, counter)
        counter = (counter + len(es)) & 15
        parts.append(es)
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    """What `parse` finds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    pcr_pid: int = -1
    continuity_errors: int = 0
    table_errors: int = 0
    #: PES packets without their start code.
    pes_errors: int = 0
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    #: Packet numbers of random-access points, one for each timestamp that has one.
    access_points: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)


def _sections(payloads: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections of one PID from (a section begins here, payload) of its packets."""
    held = b""  # what there is of a section that goes on

    def whole(data: bytes) -> tuple[list[bytes], bytes]:
        found = []
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
            if len(data) < size:
                return found, data
            found.append(data[:size])
            data = data[size:]
        return found, b"" if not data or data[0] == 0xFF else data

    for begins, data in payloads:
        if begins:
            pointer = data[0]
            if held:
                yield from whole(held + data[1 : 1 + pointer])[0]
            found, held = whole(data[1 + pointer :])
        elif held:
            found, held = whole(held + data)
        else:
            continue
        yield from found


def _continuity(packets: np.ndarray, carries: np.ndarray, announced: np.ndarray, starts: np.ndarray) -> tuple[int, np.ndarray]:
    """Errors among one PID's packets, and which of its packets carry payload that was not there before."""
    counters = packets[:, 3] & 15
    step = (counters[1:] - counters[:-1]) & 15
    twice = np.zeros(len(packets), bool)
    for i in np.flatnonzero((step == 0) & carries[1:] & carries[:-1]) + 1:
        at = starts[i]
        twice[i] = not twice[i - 1] and at == starts[i - 1] and (packets[i, at:] == packets[i - 1, at:]).all()
    right = np.where(carries[1:], (step == 1) | twice[1:], step == 0) | announced[1:]
    return int((~right).sum()), carries & ~twice


def parse(media: bytes) -> Stream:
    """Read a transport stream."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    all_packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not (all_packets[:, 0] == 0x47).all():
        raise ValueError("a packet without its sync byte")
    found = Stream(packets=len(all_packets))
    pids = (all_packets[:, 1].astype(np.int32) & 0x1F) << 8 | all_packets[:, 2]
    control = all_packets[:, 3] >> 4 & 3
    adapted = (control & 2) > 0
    starts = np.where(adapted, 5 + all_packets[:, 4].astype(np.int32), 4)
    has_flags = adapted & (all_packets[:, 4] > 0)
    announced = has_flags & (all_packets[:, 5] & 0x80 > 0)
    carries = ((control & 1) > 0) & (starts < PACKET)
    fresh = np.zeros(len(all_packets), bool)
    for pid in np.unique(pids):
        if pid != NULL_PID:
            own = np.flatnonzero(pids == pid)
            errors, fresh[own] = _continuity(all_packets[own], carries[own], announced[own], starts[own])
            found.continuity_errors += errors

    def sections(pid: int) -> Iterator[bytes]:
        where = np.flatnonzero((pids == pid) & fresh)
        for section in _sections([(bool(all_packets[i, 1] & 0x40), all_packets[i, starts[i] :].tobytes()) for i in where]):
            if section_crc(section):
                found.table_errors += 1
            else:
                yield section

    for section in sections(0):
        for i in range(8, len(section) - 4, 4):
            number = section[i] << 8 | section[i + 1]
            if number:  # 0 names the network's table
                found.programs[number] = (section[i + 2] & 0x1F) << 8 | section[i + 3]
    for pid in sorted(set(found.programs.values())):
        for section in sections(pid):
            if section[0] != 2:
                continue
            found.pcr_pid = (section[8] & 0x1F) << 8 | section[9]
            i = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while i < len(section) - 4:
                found.streams[(section[i + 1] & 0x1F) << 8 | section[i + 2]] = section[i]
                i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])
    parts: list[bytes] = []
    for pid in found.streams:
        where = np.flatnonzero((pids == pid) & fresh)
        own, own_starts = all_packets[where], starts[where]
        kept = np.arange(PACKET) >= own_starts[:, None]
        elementary = own[kept].tobytes()
        ends = np.cumsum(PACKET - own_starts)
        first = (own[:, 1] & 0x40) > 0
        begins = (ends - (PACKET - own_starts))[first]
        flags = np.where(has_flags[where], own[:, 5], 0)[first]
        for packet_no, flag, at, to in zip(where[first], flags, begins, [*begins[1:], len(elementary)]):
            head = elementary[at : at + 14]
            if len(head) < 9 or head[:3] != b"\x00\x00\x01":
                found.pes_errors += 1
                continue
            if head[7] & 0x80:
                a, b, c, d, e = head[9:14]
                found.timestamps.append((a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1)
            if flag & 0x40:
                found.access_points.append(int(packet_no))
            if flag & 0x10:
                c = all_packets[packet_no, 6:11].astype(int).tolist()
                found.clocks.append(c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7)
            length = head[4] << 8 | head[5]
            data = elementary[at + 9 + head[8] : at + 6 + length if length else to]
            parts.append(data)
    found.payload = b"".join(parts)
    return found


def feature(found: Stream) -> str:
    """One line of what the stream holds; equal payloads have equal lines."""
    program, pmt = next(iter(found.programs.items()), (-1, -1))
    return (
        f"packets={found.packets};program={program};pmt={pmt};pcr={found.pcr_pid};"
        f"streams={','.join(f'{p}:{t}' for p, t in sorted(found.streams.items()))};"
        f"cc_errors={found.continuity_errors};table_errors={found.table_errors};"
        f"pes={len(found.timestamps)};pts={found.timestamps[0] if found.timestamps else -1}-"
        f"{found.timestamps[-1] if found.timestamps else -1};access={len(found.access_points)}"
    )


_MEDIA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]
)
_PROBED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("continuity_errors", pa.int64()),
        ("timestamps", pa.list_(pa.int64())),
        ("access_points", pa.list_(pa.int64())),
    ]
)
MEDIA_DDL = "doc_id long, n_bytes long, media binary"
PROBED_DDL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, continuity_errors long, "
    "timestamps array<long>, access_points array<long>"
)


def to_media(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, media): each whole text as a transport stream. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id: int | None, data: bytes | None) -> tuple:
            data = data or b""
            return doc_id, len(data), mux(pad(data))

        return arrow_rows(batches, _MEDIA, row, at_most_bytes=BATCH_BYTES)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as binary) as data").mapInArrow(tidy(run), MEDIA_DDL)


def store(docs: DataFrame) -> DataFrame:
    """to_media, written to the shared folder."""
    return materialize(to_media(docs), "media", compression="zstd")


def probe(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> digests, timestamps and random-access points. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id: int | None, n_bytes: int, stored: bytes) -> tuple:
            found = parse(stored)
            return (
                doc_id,
                n_bytes,
                len(found.payload),
                hashlib.sha256(found.payload).hexdigest(),
                zlib.crc32(found.payload[-32:]),
                len(stored),
                hashlib.sha256(stored).hexdigest(),
                feature(found),
                found.continuity_errors,
                found.timestamps,
                found.access_points,
            )

        return arrow_rows(batches, _PROBED, row, at_most_bytes=BATCH_BYTES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), PROBED_DDL)


def media_features(docs: DataFrame) -> DataFrame:
    """What `probe` reads of the streams that `store` has written; the streams are deleted after."""
    with scratch(docs.sparkSession):
        return materialize(probe(store(docs)), "probed", keep=True)
