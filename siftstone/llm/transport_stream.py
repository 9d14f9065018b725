"""MPEG transport streams as a media column.

`mux` stores a payload losslessly: a private-data elementary stream in PES
packets with presentation time stamps, cut into 188-byte transport packets with
program tables, continuity counters, a clock reference and random-access flags.
`demux` reads any such stream back: it parses the program tables (PAT, PMT, with
their CRC), checks continuity counters, reassembles the elementary packets of
every program and keeps their time stamps with the random-access points.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import buffers, stage, texts

FRAME = 192  #: samples in an audio-like frame; payloads are padded to a multiple
FRAMES_PER_UNIT = 32
RATE = 48_000
UNITS_PER_ACCESS_POINT = 4

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PRIVATE_STREAM_1, PRIVATE_PES = 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7

PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1


@functools.cache
def _crc_table() -> tuple[int, ...]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (CRC_POLYNOMIAL if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return tuple(table)


@functools.lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A program table section behind its pointer field, stuffed to a packet."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return (b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")).ljust(PACKET - 4, b"\xff")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes, unit: int = FRAME * FRAMES_PER_UNIT) -> bytes:
    """The payload as a transport stream; one PES packet for each `unit` bytes."""
    out, count, tables = [], 0, 0
    head = bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF])
    start_head = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF])
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pts = at * CLOCK // RATE & (1 << 33) - 1
        access = k % UNITS_PER_ACCESS_POINT == 0
        if access:
            for pid, table in ((PAT_PID, _PAT), (PMT_PID, _PMT)):
                out += (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | tables & 15]), table)
            tables += 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        field_ = b"\x50" + (pts >> 1).to_bytes(4, "big") + bytes([(pts & 1) << 7 | 0x7E, 0]) if access else b""
        p, first = 0, True
        while p < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            left = len(pes) - p
            if left < room:  # stuff the adaptation field so that the packet is full
                fill = room - left
                if not field_:
                    field_, fill = (b"\x00", fill - 2) if fill >= 2 else (b"", 0)
                    adaptation = bytes([len(field_) + fill]) + field_ + b"\xff" * fill if field_ else b"\x00"
                else:
                    adaptation = bytes([len(field_) + fill]) + field_ + b"\xff" * fill
                room = left
            else:
                adaptation = bytes([len(field_)]) + field_ if field_ else b""
            out += (start_head if first else head, bytes([(0x30 if adaptation else 0x10) | count & 15]), adaptation, pes[p : p + room])
            p, first, field_, count = p + room, False, b"", count + 1
    return b"".join(out)


@dataclass
class Unit:
    """An elementary packet: its stream, time stamp, place, and data."""

    pid: int
    pts: int | None
    random_access: bool
    offset: int
    data: bytes = b""


@dataclass
class Stream:
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    damaged: int = 0

    def payload(self) -> bytes:
        return b"".join(u.data for u in self.units)

    def access_points(self) -> list[Unit]:
        return [u for u in self.units if u.random_access]


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _sections(data: bytes):
    """Sections behind a pointer field; one whose CRC fails gives None."""
    at = 1 + data[0] if data else 0
    while at + 3 <= len(data) and data[at] != 0xFF:
        end = at + 3 + ((data[at + 1] & 0x0F) << 8 | data[at + 2])
        if end > len(data):
            return
        yield data[at:end] if crc32_mpeg(data[at:end]) == 0 else None
        at = end


def demux(media: bytes) -> Stream:
    """Parses a transport stream.

    Packets without the sync byte and sections whose CRC fails count as
    damaged; jumps of a continuity counter are counted (a repeated packet is
    dropped, as the standard has it).  Bytes beyond the last whole packet count
    as one damaged packet.  Empty media gives an empty stream.
    """
    out, counters, tables = Stream(), {}, {PAT_PID: None}
    open_: dict[int, tuple[Unit, list[bytes]]] = {}
    table_parts: dict[int, bytearray] = {}

    def close(pid: int) -> None:
        if pid not in open_:
            return
        unit, parts = open_.pop(pid)
        pes = b"".join(parts)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            out.damaged += 1
            return
        declared = int.from_bytes(pes[4:6], "big")
        end = 6 + declared if declared else len(pes)
        if end > len(pes):
            out.damaged += 1
        unit.pts = _read_stamp(pes[9:14]) if pes[7] & 0x80 else None
        unit.data = pes[9 + pes[8] : end]

    def table(pid: int, data: bytes) -> None:
        for s in _sections(data):
            if s is None:
                out.damaged += 1
            elif pid == PAT_PID and s[0] == 0:
                for i in range(8, len(s) - 4, 4):
                    number, to = s[i] << 8 | s[i + 1], (s[i + 2] & 0x1F) << 8 | s[i + 3]
                    if number:
                        out.programs.setdefault(number, {})
                        tables[to] = number
            elif s[0] == 2:
                streams = out.programs.setdefault(s[3] << 8 | s[4], {})
                i = 12 + ((s[10] & 0x0F) << 8 | s[11])
                while i + 5 <= len(s) - 4:
                    streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                    i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])

    known: set[int] = set()
    for at in range(0, len(media) - PACKET + 1, PACKET):
        out.packets += 1
        b1, control = media[at + 1], media[at + 3]
        if media[at] != SYNC or b1 & 0x80:
            out.damaged += 1
            continue
        pid = (b1 & 0x1F) << 8 | media[at + 2]
        if pid == NULL_PID:
            continue
        body, access = at + 4, False
        if control & 0x20:
            n = media[body]
            access = n > 0 and bool(media[body + 1] & 0x40)
            body += 1 + n
        if not control & 0x10:
            continue
        last = counters.get(pid)
        if last is not None:
            if control & 15 == last:
                continue
            if control & 15 != (last + 1) & 15:
                out.continuity_errors += 1
        counters[pid] = control & 15
        data = media[body : at + PACKET]
        if pid in tables:
            if b1 & 0x40:
                table_parts[pid] = bytearray(data)
            elif pid in table_parts:
                table_parts[pid] += data
            if pid in table_parts:
                table(pid, bytes(table_parts[pid]))
                known = {x for streams in out.programs.values() for x in streams}
        elif pid in known:
            if b1 & 0x40:
                close(pid)
                unit = Unit(pid, None, access, at)
                out.units.append(unit)
                open_[pid] = (unit, [data])
            elif pid in open_:
                open_[pid][1].append(data)
    for pid in list(open_):
        close(pid)
    if len(media) % PACKET:
        out.damaged += 1
    return out


def feature(s: Stream) -> str:
    """What the stream holds, in one line."""
    points = s.access_points()
    stamps = [u.pts for u in s.units if u.pts is not None]
    return (
        f"programs={len(s.programs)} streams={sum(map(len, s.programs.values()))} packets={s.packets} units={len(s.units)}"
        f" pts={min(stamps, default=0)}-{max(stamps, default=0)} access_points={len(points)}"
        f" last_access={points[-1].pts if points else 0}@{points[-1].offset if points else 0}"
        f" continuity_errors={s.continuity_errors} damaged={s.damaged}"
    )


def padded(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of FRAME."""
    return text.ljust(max(FRAME, -(-len(text) // FRAME) * FRAME))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (doc_id, n_bytes, media) of each whole text as a stream.

    Null texts are stored as empty ones, null ids stay null, repeated rows give
    repeated rows, an empty table gives an empty one; other columns are left out.
    """

    def go(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            whole = data.tobytes()
            for a in range(0, batch.num_rows, 512):
                b = min(a + 512, batch.num_rows)
                media = [mux(padded(whole[offsets[i] : offsets[i + 1]])) for i in range(a, b)]
                n = offsets[a + 1 : b + 1] - offsets[a:b]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return stage(texts(df, id_col, text_col).mapInArrow(go, "doc_id long, n_bytes long, media binary"), "transport_streams")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_points array<struct<pts: long, offset: long>>"


def read(stored: DataFrame) -> DataFrame:
    """Demultiplexes the media column: digests of the payload, and its access points."""

    def go(batches):
        points = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64())]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), points]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points"]
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                media = media.as_py()
                s = demux(media)
                payload = s.payload()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [{"pts": u.pts, "offset": u.offset} for u in s.access_points()]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(go, _READ)
