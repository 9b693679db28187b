"""Media columns: texts stored as MPEG transport streams and read back.

A stream holds a program association table, a program map table and one
private elementary stream cut into access units. The reader parses the program
tables, checks continuity counters, reassembles elementary packets and keeps
each access unit's timestamp and random-access mark.

Defined cases: a null or empty text is one padded unit; equal texts give equal
streams; repeated rows are kept; columns other than the named ones are dropped;
an empty table gives an empty table. A damaged stream never raises in
``read_streams``: ``error`` names the fault and the payload is what survived.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolith.llm.batches import small_batches, strings, text_of
from geolith.tables import materialised

PACKET = 188
#: Streams in an Arrow batch.
BATCH_ROWS = 32
UNIT_MULTIPLE = 576
UNIT_BYTES = 8 * UNIT_MULTIPLE
RANDOM_ACCESS_EVERY = 16
TICKS_PER_UNIT = 3003
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD


class AccessUnit(NamedTuple):
    pid: int
    pts: int | None
    offset: int
    size: int
    random_access: bool


class Stream(NamedTuple):
    payload: bytes
    programs: dict[int, dict[int, int]]
    units: list[AccessUnit]
    continuity_errors: int
    error: str


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC of program tables (polynomial 04C11DB7, no reflection)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(0x02, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000))
)


def _pts_bytes(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def _packets(pes: bytes, counter: int, pcr: int | None) -> np.ndarray:
    """One elementary packet as transport packets; pcr: the unit is a random-access point with this clock."""
    first = 8 if pcr is not None else 0
    total = first + len(pes)
    n = -(-total // (PACKET - 4))
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    gap = n * (PACKET - 4) - total
    field = b""
    if pcr is not None:
        field = struct.pack(">BBIH", 7, 0x50, pcr >> 1, (pcr & 1) << 15 | 0x7E00)
    if n == 1 and field:
        field = bytes([7 + gap]) + field[1:] + b"\xff" * gap
        stuffing = b""
    else:
        stuffing = b"" if not gap else b"\0" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
    body = field + pes if n == 1 and field else field + pes[: (n - 1) * (PACKET - 4) - len(field)] + stuffing + pes[(n - 1) * (PACKET - 4) - len(field) :]
    out[:, 4:] = np.frombuffer(body, np.uint8).reshape(n, PACKET - 4)
    if field:
        out[0, 3] |= 0x20
    if stuffing:
        out[-1, 3] |= 0x20
    return out


def mux(payload: bytes) -> bytes:
    """payload as a transport stream of access units of UNIT_BYTES, with a clock and an access point every few units."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, pts = payload[at : at + UNIT_BYTES], (k + 1) * TICKS_PER_UNIT & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _pts_bytes(pts) + unit
        packets = _packets(pes, counter, pts if k % RANDOM_ACCESS_EVERY == 0 else None)
        counter = (counter + len(packets)) & 15
        parts.append(packets.tobytes())
    return b"".join(parts)


def _sections(packets: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Whole table sections, of one packet or several, whose checksums hold."""
    data, begun = bytearray(), False
    for packet, offset, start in zip(packets, offsets, starts, strict=True):
        body = packet[offset:].tobytes()
        if start and body:
            data, begun, body = bytearray(), True, body[1 + body[0] :]
        if not begun:
            continue
        data += body
        while len(data) >= 3 and data[0] != 0xFF and len(data) >= (size := 3 + ((data[1] & 15) << 8 | data[2])):
            section, data = bytes(data[:size]), data[size:]
            if size > 12 and not crc32_mpeg(section):
                yield section


def _units(data: bytes, at: int, pid: int, jump: bool, random_access: bool, offset: int) -> tuple[bytes, AccessUnit] | None:
    if len(data) < 9 or data[:3] != b"\0\0\1":
        return None
    length, flags, header = struct.unpack(">H", data[4:6])[0], data[7], data[8]
    pts = None
    if flags & 0x80 and len(data) >= 14:
        a, b, c = struct.unpack(">BHH", data[9:14])
        pts = (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1
    body = data[9 + header : 6 + length if length else None]
    return body, AccessUnit(pid, pts, offset, len(body), random_access)


def demux(media: bytes) -> Stream:
    """Tables, access units and payload of a transport stream."""
    error = "" if media and len(media) % PACKET == 0 else "length"
    packets = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    good = packets[:, 0] == 0x47
    if not good.all():
        error, packets = error or "sync", packets[good]
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    offsets = np.where(control & 2, 5 + packets[:, 4].astype(np.int32), 4)
    offsets = np.where(control & 1, np.minimum(offsets, PACKET), PACKET)
    starts, counters = (packets[:, 1] & 0x40) != 0, packets[:, 3] & 15

    def of(pid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = np.flatnonzero(pids == pid)
        return packets[mine], offsets[mine], starts[mine]

    programs: dict[int, dict[int, int]] = {}
    for pat in _sections(*of(0)):
        for at in range(8, len(pat) - 4, 4) if pat[0] == 0 else ():
            number, pmt_pid = struct.unpack(">HH", pat[at : at + 4])
            if not number:
                continue
            streams = programs.setdefault(number, {})
            for pmt in _sections(*of(pmt_pid & 0x1FFF)):
                if pmt[0] != 2 or struct.unpack(">H", pmt[3:5])[0] != number:
                    continue
                at_es = 12 + ((pmt[10] & 15) << 8 | pmt[11])
                while at_es + 5 <= len(pmt) - 4:
                    kind, es, info = struct.unpack(">BHH", pmt[at_es : at_es + 5])
                    streams[es & 0x1FFF] = kind
                    at_es += 5 + (info & 0xFFF)
    if not programs:
        error = error or "tables"

    payload, units, jumps = [], [], 0
    total = 0
    for pid in sorted({p for s in programs.values() for p in s}):
        mine = np.flatnonzero((pids == pid) & (control & 1 != 0))
        if not len(mine):
            continue
        step = np.diff(counters[mine].astype(np.int16)) & 15
        repeat = np.r_[False, (step == 0) & (packets[mine[1:]] == packets[mine[:-1]]).all(axis=1)]
        jumps += int(((step != 1) & ~repeat[1:]).sum())
        mine = mine[~repeat]
        rows, begin, at = packets[mine], starts[mine], offsets[mine]
        data = rows[np.arange(PACKET) >= at[:, None]].tobytes()
        bounds = np.r_[0, np.cumsum(PACKET - at)]
        access = (control[mine] & 2 != 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 != 0)
        heads = np.flatnonzero(begin)
        for h, until in zip(heads, np.r_[heads[1:], len(mine)], strict=True):
            if unit := _units(data[bounds[h] : bounds[until]], int(h), pid, False, bool(access[h]), total):
                payload.append(unit[0])
                units.append(unit[1])
                total += unit[1].size
    if jumps:
        error = error or "continuity"
    return Stream(b"".join(payload), programs, units, jumps, error)


def padded(text: str) -> tuple[int, bytes]:
    """Size of the UTF-8 text, and the text with bytes 255 up to a positive multiple of UNIT_MULTIPLE."""
    raw = text.encode("utf-8", "replace")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT_MULTIPLE)) * UNIT_MULTIPLE, b"\xff")


_UNIT = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("random_access", pa.bool_())])
_UNIT_DDL = "array<struct<pid int, pts bigint, offset bigint, size int, random_access boolean>>"
_READ = "programs string, units " + _UNIT_DDL + ", continuity_errors int, error string, payload binary"


def _described(s: Stream) -> str:
    return ";".join(f"{n}:" + ",".join(f"{p}={k}" for p, k in sorted(e.items())) for n, e in sorted(s.programs.items()))


def write_streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text muxed as a transport stream."""
    small_batches(df.sparkSession, BATCH_ROWS)
    rows = text_of(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [padded(t) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([mux(p) for _, p in both], pa.binary())], names=[id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes bigint, media binary")


def read_streams(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, programs, units (timestamps and random-access points), continuity_errors, error and payload of each stream."""
    small_batches(df.sparkSession, BATCH_ROWS)
    rows = df.select(f"`{id_col}`", f"`{media_col}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [demux(m or b"") for m in b.column(1).to_pylist()]
            columns = [pa.array([_described(s) for s in read], pa.string()), pa.array([[u._asdict() for u in s.units] for s in read], pa.list_(_UNIT)), pa.array([s.continuity_errors for s in read], pa.int32()), pa.array([s.error for s in read], pa.string()), pa.array([s.payload for s in read], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, "programs", "units", "continuity_errors", "error", "payload"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {_READ}")


_DIGEST = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def stream_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a transport stream in a written media column, read back from it, and described by sizes, digests and a feature string."""
    small_batches(df.sparkSession, BATCH_ROWS)
    stored = materialised(write_streams(df, id_col, text_col), compression="zstd", group_bytes=8 << 20)

    def digest(media: bytes) -> tuple:
        s = demux(media)
        pts = [u.pts for u in s.units]
        feature = f"programs={_described(s)} packets={len(media) // PACKET} units={len(s.units)} pts={pts[0]}-{pts[-1]} access={','.join(str(u.pts) for u in s.units if u.random_access)} continuity_errors={s.continuity_errors} error={s.error or 'none'}"
        return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*map(digest, b.column(2).to_pylist()), strict=True)) or [()] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, t) for v, (_, t) in zip(made, _DIGEST, strict=True)]], names=[id_col, "n_bytes", *[n for n, _ in _DIGEST]])

    names = {pa.int64(): "bigint", pa.string(): "string"}
    return stored.mapInArrow(run, f"`{id_col}` {stored.schema[0].dataType.simpleString()}, n_bytes bigint, " + ", ".join(f"{n} {names[t]}" for n, t in _DIGEST))
