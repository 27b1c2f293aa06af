"""Media columns as MPEG transport streams (188-byte packets).

``multiplex`` stores a payload as one elementary stream: a program association
and a program map table in front of every random-access point, access units in
PES packets with a presentation timestamp, adaptation fields with the clock
reference, continuity counters, and stuffing in the last packet. ``demultiplex``
parses the program tables (with their CRC, over as many packets as they take), checks
the counters of the stream, reassembles the PES packets and reports each unit's
timestamps and place, and which units are random-access points. The bytes come back
exactly. Streams of other makers are read too: several programs and streams (``program``
and ``pid`` choose, else the first), units of undeclared length, repeated packets,
declared discontinuities, decoding timestamps, other streams' packets in between, units without an optional header,
tables for later (which do not hold yet) and later versions (whose streams are added).

Defined results: a null or empty text has a payload of 64 zero bytes. A stream
with a length that is no multiple of 188, a lost sync byte, or no readable
program table raises ``ValueError`` from ``demultiplex``; ``decode_media`` turns that into
a null payload and the reason. Missing packets are counted in ``cc_errors`` (a gap each) and the unit
they belong to is marked damaged and left out of the payload; a packet received with errors is missing, a scrambled one damages its unit,
padding units are empty. A counter that stands still is a repeat
only if the packet has the same bytes, but for its clock. An empty table gives an empty one; null media gives nulls.
Added columns replace columns of their names; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import map_text

PACKET = 188
BODY = PACKET - 4
PMT_PID, STREAM_PID, PROGRAM = 0x1000, 0x0100, 1
#: Private data in PES packets, and its stream id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
CLOCK_FIELD = 8
PES_HEADER = 14
#: A unit of this size fills its 45 packets exactly.
UNIT = (BODY - CLOCK_FIELD - PES_HEADER) + 44 * BODY
#: 90 kHz ticks from unit to unit, and units from one random-access point to the next.
TICKS, RANDOM_ACCESS_EVERY = 3600, 12
ALIGN = 64


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, not reflected, all ones at the start."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@lru_cache(8)
def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter & 15) + b"\0" + section).ljust(PACKET, b"\xff")


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _unit_packets(data: bytes, pts: int, random_access: bool, counter: int) -> bytes:
    """The packets of one access unit; ``counter`` is the first one's continuity counter."""
    pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x80, 0x80, 5) + _timestamp(pts) + data
    clock = struct.pack(">Q", pts << 31 | 0x3F << 25)[:6]
    room = BODY - CLOCK_FIELD
    stuffing = max(0, room - len(pes))
    first = struct.pack(">BHB", 0x47, 0x4000 | STREAM_PID, 0x30 | counter & 15)
    first += bytes([CLOCK_FIELD - 1 + stuffing, 0x50 if random_access else 0x10]) + clock + b"\xff" * stuffing + pes[:room]
    rest = pes[room:]
    whole, tail = divmod(len(rest), BODY)
    out = [first]
    if whole:
        packets = np.empty((whole, PACKET), np.uint8)
        packets[:, :3] = (0x47, STREAM_PID >> 8, STREAM_PID & 0xFF)
        packets[:, 3] = 0x10 | (counter + 1 + np.arange(whole) & 15)
        packets[:, 4:] = np.frombuffer(rest, np.uint8, whole * BODY).reshape(whole, BODY)
        out.append(packets.tobytes())
    if tail:
        length = BODY - 1 - tail
        adaptation = bytes([length]) + (b"\0" + b"\xff" * (length - 1) if length else b"")
        out.append(struct.pack(">BHB", 0x47, STREAM_PID, 0x30 | counter + 1 + whole & 15) + adaptation + rest[whole * BODY :])
    return b"".join(out)


def multiplex(payload: bytes) -> bytes:
    """``payload`` as a transport stream of one program with one elementary stream."""
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000))
    out, counter, tables = [], 0, 0
    for k, start in enumerate(range(0, max(1, len(payload)), UNIT)):
        random_access = k % RANDOM_ACCESS_EVERY == 0
        if random_access:
            out += [_table_packet(0, pat, tables), _table_packet(PMT_PID, pmt, tables)]
            tables += 1
        packets = _unit_packets(payload[start : start + UNIT], k * TICKS & (1 << 33) - 1, random_access, counter)
        counter += len(packets) // PACKET
        out.append(packets)
    return b"".join(out)


@dataclass
class Stream:
    """What ``demultiplex`` found: the payload and its units as (pts, offset, length, random access, damaged, dts); -1 for no timestamp.

    ``programs`` has every program's streams as (pid, type).
    """

    payload: bytes = b""
    program: int = 0
    pid: int = 0
    stream_type: int = 0
    packets: int = 0
    cc_errors: int = 0
    units: list[tuple[int, int, int, bool, bool, int]] = field(default_factory=list)
    programs: dict[int, list[tuple[int, int]]] = field(default_factory=dict)


#: Stream ids whose packets have data right behind their length; that of padding has none worth keeping.
PLAIN_IDS, PADDING_ID = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


def _body(raw: bytes) -> bytes:
    """A packet's payload."""
    start = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    return raw[start:] if raw[3] & 0x10 else b""


def _sections(packets: np.ndarray) -> list[bytes]:
    """Sections with a right CRC in the packets of one table, however many packets each takes."""
    found: list[bytes] = []
    held, counter = None, None

    def taken(held: bytes) -> bytes:
        """``held`` less the whole sections at its beginning; stuffing ends it."""
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0x0FFF)
            if len(held) < size:
                return held
            section, held = held[:size], held[size:]
            if size >= 12 and crc32_mpeg(section[:-4]) == struct.unpack(">I", section[-4:])[0]:
                found.append(section)
        return held if held[:1] != b"\xff" else b""

    for row in packets:
        raw = row.tobytes()
        body, now = _body(raw), raw[3] & 15
        if not body or counter == now:
            continue
        if counter is not None and now != counter + 1 & 15:
            held = None
        counter = now
        if raw[1] & 0x40:
            pointer = body[0]
            if held is not None:
                taken(held + body[1 : 1 + pointer])
            held = taken(body[1 + pointer :])
        elif held is not None:
            held = taken(held + body)
    return found


def _programs(packets: np.ndarray, pids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Program number -> its streams as (pid, type), by the program tables."""
    where: dict[int, list[int]] = {}
    for section in _sections(packets[pids == 0]):
        for at in range(8, len(section) - 4 - 3, 4):
            number, pid = struct.unpack_from(">HH", section, at)
            if section[0] == 0 and number and section[5] & 1 and pid & 0x1FFF not in where.setdefault(number, []):
                where[number].append(pid & 0x1FFF)
    if not where:
        raise ValueError("no program association table")
    programs: dict[int, list[tuple[int, int]]] = {}
    for number, table in ((n, t) for n, tables in where.items() for t in tables):
        for section in _sections(packets[pids == table]):
            # tables that are announced for later do not hold yet
            if section[0] != 2 or struct.unpack_from(">H", section, 3)[0] != number or not section[5] & 1:
                continue
            at, streams = 12 + (struct.unpack_from(">H", section, 10)[0] & 0x0FFF), programs.setdefault(number, [])
            while at + 5 <= len(section) - 4:
                one = (struct.unpack_from(">H", section, at + 1)[0] & 0x1FFF, section[at])
                if one not in streams:  # later versions add to what earlier ones hold
                    streams.append(one)
                at += 5 + (struct.unpack_from(">H", section, at + 3)[0] & 0x0FFF)
    if not any(programs.values()):
        raise ValueError("no program map table")
    return programs


def _same(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether a packet repeats another: all bytes alike, but for the clock of its adaptation field."""
    if one[3] & 0x20 and one[4] >= 7 and one[5] & 0x10:
        one, two = np.delete(one, np.s_[6:12]), np.delete(two, np.s_[6:12])
    return bool((one == two).all())


def _time(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def demultiplex(media: bytes, program: int | None = None, pid: int | None = None) -> Stream:
    """Parse a transport stream and reassemble one elementary stream: the first of the first program, or the one asked for."""
    if not media or len(media) % PACKET:
        raise ValueError("no whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a packet has no sync byte")
    # a packet marked as received with errors may lie in any of its fields, its stream's number too: it is missing
    pids = np.where(packets[:, 1] & 0x80, -1, (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2])
    clear = packets[:, 3] & 0xC0 == 0
    stream = Stream(packets=len(packets), programs=_programs(packets[clear], pids[clear]))
    chosen = [(n, p, t) for n, streams in stream.programs.items() for p, t in streams if program in (None, n) and pid in (None, p)]
    if not chosen:
        raise ValueError("no such stream in the program tables")
    stream.program, stream.pid, stream.stream_type = chosen[0]
    own = packets[pids == stream.pid]
    own = own[own[:, 3] & 0x10 > 0]
    control = own[:, 3]
    adapted = (control & 0x20 > 0) & (own[:, 4] > 0)
    step = np.concatenate(([1], np.diff(control.astype(np.int16) & 15) & 15))[: len(own)]
    still = np.flatnonzero(step == 0)
    fresh = np.ones(len(own), bool)
    fresh[[k for k in still if _same(own[k], own[k - 1])]] = False
    gap = fresh & (step != 1) & ~(adapted & (own[:, 5] & 0x80 > 0))  # a declared discontinuity is no error
    stream.cc_errors = int(gap.sum())
    own, control, gap, adapted = own[fresh], control[fresh], gap[fresh], adapted[fresh]
    hidden = control & 0xC0 > 0
    start = 4 + np.where(control & 0x20 > 0, 1 + own[:, 4].astype(np.int32), 0)
    random_access = adapted & (own[:, 5] & 0x40 > 0)
    body = own[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - np.minimum(start, PACKET))
    heads = np.flatnonzero(own[:, 1] & 0x40)
    begins = np.concatenate(([0], ends))
    parts, offset = [], 0
    for k, head in enumerate(heads):
        after = heads[k + 1] if k + 1 < len(heads) else len(own)
        pes = body[begins[head] : begins[after]]
        plain = len(pes) >= 6 and pes[3] in PLAIN_IDS
        data_at = 6 if plain else 9 + pes[8] if len(pes) >= 9 else 9
        whole = pes[:3] == b"\0\0\1" and len(pes) >= data_at
        length = struct.unpack_from(">H", pes, 4)[0] if whole else 0
        # length 0 leaves the end to the next unit's beginning, and a gap there may have taken some of it
        lost = gap[head + 1 : after + (length == 0)].any() or hidden[head:after].any()
        good = whole and length + 6 in (6, len(pes)) and not lost
        pts = dts = -1
        if good and not plain and pes[7] & 0x80 and pes[8] >= 5:
            pts = dts = _time(pes[9:14])
            if pes[7] & 0x40 and pes[8] >= 10:
                dts = _time(pes[14:19])
        data = pes[data_at:] if good and pes[3] != PADDING_ID else b""
        stream.units.append((pts, offset, len(data), bool(random_access[head]), not good, dts))
        parts.append(data)
        offset += len(data)
    stream.payload = b"".join(parts)
    return stream


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ALIGN if raw else ALIGN), len(raw)


def feature(stream: Stream) -> str:
    """A readable summary of the stream and its samples."""
    samples = np.frombuffer(stream.payload, np.uint8)
    raps = sum(u[3] for u in stream.units)
    pts = [u[0] for u in stream.units] or [-1]
    return f"pid={stream.pid};type={stream.stream_type};packets={stream.packets};units={len(stream.units)};rap={raps};pts={pts[0]}-{pts[-1]};cc_errors={stream.cc_errors};sum={int(samples.sum(dtype=np.int64))};max={int(samples.max(initial=0))}"


UNITS = "array<struct<pts:long,offset:long,length:long,random_access:boolean,damaged:boolean,dts:long>>"
_UNIT_TYPE = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("damaged", pa.bool_()), ("dts", pa.int64())]))


def _units(streams: list[Stream | None]) -> pa.Array:
    names = ("pts", "offset", "length", "random_access", "damaged", "dts")
    return pa.array([None if s is None else [dict(zip(names, u)) for u in s.units] for s in streams], _UNIT_TYPE)


def encode_media(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with ``media``, the binary column ``payload`` as a transport stream (null for null)."""
    return map_text(df, payload, "media binary", lambda: lambda values: [pa.array([None if v is None else multiplex(v) for v in values], pa.binary())])


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``payload``, ``units``, ``cc_errors`` and ``problem`` of the binary column ``media``."""

    def start():
        def work(values: list) -> list[pa.Array]:
            streams, problems = [], []
            for v in values:
                try:
                    streams.append(None if v is None else demultiplex(v))
                    problems.append(None)
                except ValueError as why:
                    streams.append(None)
                    problems.append(str(why))
            return [
                pa.array([None if s is None else s.payload for s in streams], pa.binary()),
                _units(streams),
                pa.array([None if s is None else s.cc_errors for s in streams], pa.int32()),
                pa.array(problems, pa.string()),
            ]

        return work

    return map_text(df, media, f"payload binary, units {UNITS}, cc_errors int, problem string", start)


def media_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text stored as a stream and read back: digests, a feature string and the timestamps with random-access points.

    The stream is made and read within one pass, so that its bytes do not travel through the plan.
    """

    def start():
        def work(texts: list) -> list[pa.Array]:
            sizes, streams, media_sizes, media_sums = [], [], [], []
            for text in texts:
                payload, size = padded(text)
                media = multiplex(payload)
                sizes.append(size), streams.append(demultiplex(media)), media_sizes.append(len(media)), media_sums.append(hashlib.sha256(media).hexdigest())
            payloads = [s.payload for s in streams]
            return [
                pa.array(sizes, pa.int64()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-ALIGN:]) for p in payloads], pa.int64()),
                pa.array(media_sizes, pa.int64()),
                pa.array(media_sums),
                pa.array([feature(s) for s in streams]),
                pa.array([[u[0] for u in s.units if u[3]] for s in streams], pa.list_(pa.int64())),
            ]

        return work

    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, random_access_pts array<long>"
    return map_text(docs, text, added, start, keep_text=False)
