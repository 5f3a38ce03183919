"""MPEG transport streams as a media column.

``mux`` stores a payload losslessly as a single-program transport stream (ISO/IEC
13818-1): PAT, PMT, then PES packets of private data with PTS, PCR and random-access
flags.  ``demux`` reads any transport stream back: program tables with their CRC,
continuity counters, reassembled elementary packets, timestamps and random-access
points.  Both handle all 188-byte packets of a stream as one array.

Defined cases: a null or empty text is a payload of 64 zero bytes; equal texts give equal
media; lost packets are counted in ``cc_errors`` and the damaged packet is kept but
flagged ``broken``; exact duplicate packets are dropped as the standard allows; extra
columns of the input are ignored and repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import bytekit as bk

PACKET = 188
PID_PMT, PID_DATA = 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 4096
UNITS_PER_RAP = 4
TICKS_PER_UNIT = 3600  # 25 units a second on the 90 kHz clock
_PES_HEADER = 14
_AF_PCR = 8  # adaptation field with length, flags and PCR


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out[i] = c
    return out


_CRC = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _psi_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = np.frombuffer(
    _psi_packet(0, _section(0x00, 1, b"\x00\x01" + (0xE000 | PID_PMT).to_bytes(2, "big")))
    + _psi_packet(PID_PMT, _section(0x02, 1, (0xE000 | PID_DATA).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | PID_DATA).to_bytes(2, "big") + b"\xf0\x00")),
    np.uint8,
).reshape(2, PACKET)

_COLUMN = np.arange(PACKET)


def _stamp(prefix: int, pts: np.ndarray) -> list[np.ndarray]:
    """The five bytes of a PTS or DTS field."""
    return [(prefix << 4) | ((pts >> 30) & 7) << 1 | 1, (pts >> 22) & 0xFF, ((pts >> 15) & 0x7F) << 1 | 1, (pts >> 7) & 0xFF, (pts & 0x7F) << 1 | 1]


def mux(payload: np.ndarray) -> np.ndarray:
    """The transport stream that carries ``payload``; its layout follows from the length alone."""
    n = len(payload)
    units = -(-n // UNIT_BYTES)
    size = np.full(units, UNIT_BYTES, np.int64)
    size[-1] = n - UNIT_BYTES * (units - 1)
    room = PACKET - 4 - _AF_PCR - _PES_HEADER
    packets = 1 + np.maximum(0, -(-(size - room) // (PACKET - 4)))
    first = np.concatenate([[0], np.cumsum(packets)])
    total = int(first[-1])
    first = first[:-1]
    data = np.full(total, PACKET - 4, np.int64)
    data[first] = np.minimum(size, room)
    last = first + packets - 1
    data[last] = np.where(packets > 1, size - room - (packets - 2) * (PACKET - 4), size)
    out = np.full((total, PACKET), 0xFF, np.uint8)
    head = PACKET - data
    out[:, 0] = 0x47
    out[:, 1] = PID_DATA >> 8
    out[first, 1] |= 0x40
    out[:, 2] = PID_DATA & 0xFF
    stuffed = head > 4
    stuffed[first] = True
    out[:, 3] = np.where(stuffed, 0x30, 0x10) | (np.arange(total) & 15)
    field_bytes = head.copy()
    field_bytes[first] -= _PES_HEADER
    short = np.flatnonzero(stuffed)
    out[short, 4] = field_bytes[short] - 5
    flagged = short[field_bytes[short] > 5]
    out[flagged, 5] = 0
    unit = np.arange(units)
    pts = (unit + 1) * TICKS_PER_UNIT
    pcr = unit * TICKS_PER_UNIT
    out[first, 5] = np.where(unit % UNITS_PER_RAP == 0, 0x50, 0x10)
    for k, value in enumerate([(pcr >> 25) & 0xFF, (pcr >> 17) & 0xFF, (pcr >> 9) & 0xFF, (pcr >> 1) & 0xFF, ((pcr & 1) << 7) | 0x7E, pcr * 0]):
        out[first, 6 + k] = value
    pes = head[first] - _PES_HEADER
    length = size + _PES_HEADER - 6
    for k, value in enumerate([0, 0, 1, STREAM_ID, length >> 8, length & 0xFF, 0x84, 0x80, 5, *_stamp(2, pts)]):
        out[first, pes + k] = value
    out[_COLUMN >= head[:, None]] = payload
    return np.concatenate([_TABLES, out]).reshape(-1)


@dataclass
class Unit:
    """One elementary packet: its data, timestamps on the 90 kHz clock, and whether decoding may start there."""

    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    broken: bool
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, dict[int, int]] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    cc_errors: int = 0
    duplicates: int = 0
    crc_errors: int = 0
    sync_errors: int = 0


def _sections(chunk: bytes) -> Iterator[bytes]:
    """Sections of a PSI payload that starts with its pointer field."""
    at = 1 + chunk[0] if chunk else 0
    while at + 3 <= len(chunk) and chunk[at] != 0xFF:
        end = at + 3 + ((chunk[at + 1] & 0x0F) << 8 | chunk[at + 2])
        if end > len(chunk):
            return
        yield chunk[at:end]
        at = end


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes | np.ndarray) -> Stream:
    """Program tables, continuity and elementary packets of a transport stream."""
    raw = np.frombuffer(media, np.uint8) if isinstance(media, (bytes, bytearray, memoryview)) else media
    out = Stream()
    rows = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    good = rows[:, 0] == 0x47
    out.sync_errors = int((~good).sum()) + (len(raw) % PACKET > 0)
    rows = rows if good.all() else rows[good]
    out.packets = len(rows)
    wide = rows[:, 1:5].astype(np.int64)
    pid = (wide[:, 0] & 0x1F) << 8 | wide[:, 1]
    starts = (wide[:, 0] & 0x40) > 0
    control = wide[:, 2] >> 4 & 3
    has_field, has_data = (control & 2) > 0, (control & 1) > 0
    begin = np.where(has_field, 5 + wide[:, 3], 4)
    flags = np.where(has_field & (wide[:, 3] > 0), rows[:, 5], 0)
    counter = wide[:, 2] & 15

    def chunks(wanted: int) -> Iterator[tuple[bytes, bool, bool]]:
        """Reassembled payloads of one PID: bytes, random access, broken."""
        at = np.flatnonzero((pid == wanted) & has_data & (begin < PACKET))
        if not len(at):
            return
        c = counter[at]
        step = np.diff(c) % 16
        same = np.zeros(len(at), bool)
        twice = np.flatnonzero(step == 0) + 1
        if len(twice):
            same[twice] = (rows[at[twice]] == rows[at[twice - 1]]).all(axis=1)
        lost = np.zeros(len(at), bool)
        lost[1:] = (step != 1) & ~same[1:] & ((flags[at[1:]] & 0x80) == 0)
        out.duplicates += int(same.sum())
        out.cc_errors += int(lost.sum())
        at, lost = at[~same], lost[~same]
        opens = np.flatnonzero(starts[at])
        body = rows[at][_COLUMN >= begin[at][:, None]].tobytes()
        edge = np.concatenate([[0], np.cumsum(PACKET - begin[at])])
        for i, a in enumerate(opens):
            b = opens[i + 1] if i + 1 < len(opens) else len(at)
            yield body[edge[a] : edge[b]], bool(flags[at[a]] & 0x40), bool(lost[a + 1 : b].any())

    def tables(wanted: int, table_id: int) -> Iterator[bytes]:
        for chunk, _, _ in chunks(wanted):
            for s in _sections(chunk):
                if crc32_mpeg(s):
                    out.crc_errors += 1
                elif s[0] == table_id:
                    yield s

    for s in tables(0, 0x00):
        for k in range(8, len(s) - 4, 4):
            if number := s[k] << 8 | s[k + 1]:
                out.programs[number] = (s[k + 2] & 0x1F) << 8 | s[k + 3]
    for number, where in out.programs.items():
        for s in tables(where, 0x02):
            if (s[3] << 8 | s[4]) != number:
                continue
            k = 12 + ((s[10] & 0x0F) << 8 | s[11])
            found = out.streams.setdefault(number, {})
            while k + 5 <= len(s) - 4:
                found[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    for where in dict.fromkeys(p for found in out.streams.values() for p in found):
        for chunk, random_access, broken in chunks(where):
            if len(chunk) < 9 or chunk[:3] != b"\x00\x00\x01":
                continue
            declared = chunk[4] << 8 | chunk[5]
            end = 6 + declared if declared else len(chunk)
            pts = _read_stamp(chunk[9:14]) if chunk[7] & 0x80 and len(chunk) >= 14 else None
            dts = _read_stamp(chunk[14:19]) if chunk[7] & 0x40 and len(chunk) >= 19 else pts
            out.units.append(Unit(where, chunk[3], pts, dts, random_access, broken or end > len(chunk), chunk[9 + chunk[8] : end]))
    return out


def feature(s: Stream) -> str:
    """What the stream says of itself, as one line."""
    pts = [u.pts for u in s.units if u.pts is not None]
    tables = ",".join(f"{n}:{where:#x}[{' '.join(f'{p:#x}={t:#04x}' for p, t in sorted(s.streams.get(n, {}).items()))}]" for n, where in sorted(s.programs.items()))
    return f"programs={tables};packets={s.packets};units={len(s.units)};random_access={sum(u.random_access for u in s.units)};pts={min(pts, default=-1)}..{max(pts, default=-1)};cc_errors={s.cc_errors};crc_errors={s.crc_errors};broken={sum(u.broken for u in s.units)}"


def padded(text: np.ndarray) -> np.ndarray:
    out = np.zeros(max(64, -(-len(text) // 64) * 64), np.uint8)
    out[: len(text)] = text
    return out


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``: the text's padded bytes as a transport stream."""
    docs = bk.bounded_batches(docs.select(id_column, text_column))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in bk.groups(batch, text_column):
                media = [mux(padded(buf[a:b])).tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], [id_column, "n_bytes", "media"])

    return bk.map_arrow(docs, run, f"{id_column} {kind}, n_bytes long, media binary")


def access_points(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each elementary packet: where it is, its timestamps, random access or not."""
    stored = stored.select(id_column, "media")
    kind = stored.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0), batch.column(1), strict=True):
                u = demux(media.as_py() or b"").units
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(u), batch.column(0).type), pa.array([x.pid for x in u], pa.int32()), pa.array(range(len(u)), pa.int32()), pa.array([x.pts for x in u], pa.int64()), pa.array([x.dts for x in u], pa.int64()), pa.array([x.random_access for x in u], pa.bool_()), pa.array([x.broken for x in u], pa.bool_()), pa.array([x.data for x in u], pa.binary())],
                    [id_column, "pid", "unit", "pts", "dts", "random_access", "broken", "data"],
                )

    return bk.map_arrow(stored, run, f"{id_column} {kind}, pid int, unit int, pts long, dts long, random_access boolean, broken boolean, data binary")


def read_back(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Reads the stored streams and reports payload, media and features; the payload comes from the elementary packets alone."""
    stored = stored.select(id_column, "n_bytes", "media")
    kind = stored.schema[id_column].dataType.simpleString()
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                raw = media.as_buffer()
                s = demux(np.frombuffer(raw, np.uint8))
                data = b"".join(u.data for u in s.units)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), raw.size, hashlib.sha256(raw).hexdigest(), feature(s)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return bk.map_arrow(stored, run, f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
