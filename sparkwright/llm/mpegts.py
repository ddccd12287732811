"""MPEG transport streams as media columns.

``pack_streams`` stores payloads as transport streams (program tables, elementary packets with
timestamps, random-access points). ``read_streams`` reads any column of transport streams:
it finds packets again after stray or missing bytes, parses the program association and map tables, checks continuity counters per PID, drops
repeated packets, reassembles the packetised elementary stream and returns for each access unit its
timestamps and whether a random-access point begins it.

Defined results: a null or empty payload becomes one unit of padding; a null stream, or bytes without
a sync pattern, yields no units and ``n_packets`` 0; trailing bytes of less than a packet are ignored.
Rows are independent, so repeated rows give repeated results; extra columns are ignored, whatever their names; an empty table gives no rows. Memory is bounded by one Arrow slice
(4 MB of text) or by one row if that is longer.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0101, 0x06, 0xBD
CLOCK, PTS_BITS = 90_000, 33
NO_HEADER_IDS = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))

UNIT, AT_ONCE, TICK = 576, 10, 3_600
"""Payload granule in bytes; granules per access unit; clock ticks from unit to unit (25 a second)."""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables (not reflected, no final inversion)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = bytes((table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255)) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes((SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0)) + section
    return packet + b"\xff" * (PACKET - len(packet))


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section_packet(PAT_PID, 0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    es = bytes((STREAM_TYPE,)) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    return pat + _section_packet(PMT_PID, 0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + es)


@lru_cache(maxsize=64)
def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packets of one access unit of ``size`` bytes without payload, and the mask of payload places."""
    first = PACKET - 4 - 8 - 14
    n = 1 + max(0, -(-(size - first) // 184))
    packets, mask = np.full((n, PACKET), 0xFF, np.uint8), np.zeros((n, PACKET), bool)
    packets[:, 0], packets[:, 1], packets[:, 2], packets[:, 3] = SYNC, ES_PID >> 8, ES_PID & 255, 0x10
    stuffing, length = max(0, first - size), 8 + size
    packets[0, 1] |= 0x40
    packets[0, 3] = 0x30
    packets[0, 4:6] = 7 + stuffing, 0x50
    at = 12 + stuffing
    packets[0, at : at + 9] = 0, 0, 1, STREAM_ID, length >> 8, length & 255, 0x80, 0x80, 5
    mask[0, at + 14 :] = True
    if n > 1:
        mask[1:, 4:] = True
        left = size - first - 184 * (n - 2)
        if left < 184:
            packets[-1, 3] = 0x30
            packets[-1, 4] = 183 - left
            if left < 183:
                packets[-1, 5] = 0
            mask[-1, : PACKET - left] = False
    return packets, mask


def pack(payload: bytes) -> bytes:
    """A transport stream that holds ``payload`` (a positive multiple of 576 bytes) without loss."""
    data = np.frombuffer(payload, np.uint8)
    full, rest = divmod(len(data), UNIT * AT_ONCE)
    parts, counter = [], 0
    for count, size, start in ((full, UNIT * AT_ONCE, 0), (int(rest > 0), rest, full)):
        if not count:
            continue
        packets, mask = _layout(size)
        block = np.repeat(packets[None], count, 0)
        block[:, mask] = data[start * UNIT * AT_ONCE :][: count * size].reshape(count, size)
        time = (np.arange(start, start + count, dtype=np.int64) * TICK) & ((1 << PTS_BITS) - 1)
        for k, shift in enumerate((25, 17, 9, 1)):
            block[:, 0, 6 + k] = time >> shift & 255
        block[:, 0, 10], block[:, 0, 11] = (time & 1) << 7 | 0x7E, 0
        at = int(np.flatnonzero(mask[0])[0]) - 5 if mask[0].any() else PACKET - 5
        block[:, 0, at] = 0x21 | (time >> 30 & 7) << 1
        block[:, 0, at + 1] = time >> 22 & 255
        block[:, 0, at + 2] = (time >> 15 & 127) << 1 | 1
        block[:, 0, at + 3] = time >> 7 & 255
        block[:, 0, at + 4] = (time & 127) << 1 | 1
        block = block.reshape(-1, PACKET)
        block[:, 3] |= ((counter + np.arange(len(block))) & 15).astype(np.uint8)
        counter += len(block)
        parts.append(block)
    return _tables() + np.concatenate(parts).tobytes()


@dataclass
class Unit:
    """One reassembled elementary packet."""

    pid: int
    pts: int | None
    dts: int | None
    pcr: int | None
    random_access: bool
    complete: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    n_packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)
    continuity_errors: int = 0
    repeated: int = 0
    bad_tables: int = 0
    sync_losses: int = 0
    units: list[Unit] = field(default_factory=list)


def _sync(data: np.ndarray, start: int) -> int:
    """The first place from ``start`` on where a whole packet begins and the sync byte repeats at packet distance; -1 if there is none."""
    last = len(data) - PACKET
    for k in np.flatnonzero(data[start : last + 1] == SYNC) + start if start <= last else ():
        if (data[k : last + 1 : PACKET][:5] == SYNC).all():
            return int(k)
    return -1


def _aligned(media: bytes) -> tuple[np.ndarray, int]:
    """Whole packets, and how often the sync byte was lost and found again elsewhere. One damaged sync byte between good ones costs its packet alone."""
    data, blocks, losses = np.frombuffer(media, np.uint8), [], 0
    at = _sync(data, 0)
    while at >= 0:
        n = (len(data) - at) // PACKET
        block = data[at : at + n * PACKET].reshape(n, PACKET)
        bad = block[:, 0] != SYNC
        lost = np.flatnonzero(bad & np.append(bad[1:], False))
        if not len(lost) and not bad[-1]:
            blocks.append(block)
            break
        k = int(lost[0]) if len(lost) else n - 1
        # Where bytes are missing, the next packet begins inside the last good one.
        found = _sync(data, at + (k - 1) * PACKET + 1)
        blocks.append(block[: k - (0 <= found < at + k * PACKET)])
        losses += found >= 0
        at = found
    return (np.concatenate(blocks) if blocks else np.zeros((0, PACKET), np.uint8)), losses


def _sections(payloads: list[tuple[bool, bytes]], out: Stream):
    """Whole program-table sections with a right CRC, over as many packets as they take."""
    held = b""
    for start, data in payloads:
        if start:
            tail, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            held += tail if held else b""
        elif not held:
            continue
        pending, held = [held] if held and start else [], data if start else held + data
        for piece in pending:
            yield from _cut(piece, out)[0]
        found, held = _cut(held, out)
        yield from found


def _cut(data: bytes, out: Stream) -> tuple[list[bytes], bytes]:
    found = []
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if len(data) < size:
            return found, data
        section, data = data[:size], data[size:]
        if size >= 12 and crc32_mpeg(section) == 0:
            found.append(section)
        else:
            out.bad_tables += 1
    return found, b"" if data[:1] == b"\xff" else data


def _clock(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def parse(media: bytes | None) -> Stream:
    """Parse a transport stream: program tables, continuity, elementary packets, timestamps."""
    out = Stream()
    p, out.sync_losses = _aligned(media or b"")
    p = p[(p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)] if len(p) else p
    out.n_packets = len(p)
    if not len(p):
        return out
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    start, has_af, has_data, counter = p[:, 1] & 0x40 > 0, p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0, p[:, 3] & 15
    af = np.where(has_af, p[:, 4].astype(np.int32), -1)
    at = np.minimum(4 + af + 1, PACKET)
    flags = np.where(af > 0, p[:, 5], 0)
    keep = np.ones(len(p), bool)
    by_pid = {int(k): np.flatnonzero(pid == k) for k in np.unique(pid) if k != NULL_PID}
    for rows in by_pid.values():
        rows = rows[has_data[rows]]
        if len(rows) > 1:
            a, b = rows[:-1], rows[1:]
            same = (counter[a] == counter[b]) & (p[a, 3] == p[b, 3])
            if same.any():
                same[same] = (p[a[same], 4:] == p[b[same], 4:]).all(1)
            wrong = ~same & (counter[b] != (counter[a] + 1 & 15)) & (flags[b] & 0x80 == 0)
            keep[b[same]] = False
            out.repeated += int(same.sum())
            out.continuity_errors += int(wrong.sum())
    tables = lambda k: [(bool(start[i]), p[i, at[i] :].tobytes()) for i in by_pid.get(k, ()) if keep[i] and has_data[i] and at[i] < PACKET]
    for s in _sections(tables(PAT_PID), out):
        if s[0] == 0 and s[5] & 1:  # a table that is announced for later is not applied
            for i in range(8, len(s) - 7, 4):
                if number := s[i] << 8 | s[i + 1]:
                    out.programs[number] = (s[i + 2] & 31) << 8 | s[i + 3]
    for number, k in out.programs.items():
        for s in _sections(tables(k), out):
            if s[0] == 2 and s[5] & 1 and s[3] << 8 | s[4] == number:
                i = 12 + ((s[10] & 15) << 8 | s[11])
                while i + 5 <= len(s) - 4:
                    out.streams[(s[i + 1] & 31) << 8 | s[i + 2]] = (s[i], number)
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    for k in out.streams:
        rows = by_pid.get(k, np.zeros(0, int))
        rows = rows[keep[rows] & has_data[rows]]
        if not len(rows):
            continue
        data = p[rows][np.arange(PACKET)[None] >= at[rows][:, None]].tobytes()
        ends = np.cumsum(PACKET - at[rows])
        begins = np.flatnonzero(start[rows])
        for i, j in zip(begins, [*begins[1:], len(rows)], strict=True):
            r, pes = rows[i], data[ends[i] - (PACKET - at[rows[i]]) : ends[j - 1]]
            if len(pes) < 6 or pes[:3] != b"\0\0\1":
                continue
            size, pts, dts, body = pes[4] << 8 | pes[5], None, None, 6
            if pes[3] not in NO_HEADER_IDS and len(pes) >= 9:
                body = 9 + pes[8]
                if pes[7] & 0x80 and len(pes) >= 14:
                    pts = _clock(pes[9:14])
                if pes[7] & 0xC0 == 0xC0 and len(pes) >= 19:
                    dts = _clock(pes[14:19])
            pcr = None
            if flags[r] & 0x10 and af[r] >= 7:
                b = p[r, 6:12].astype(object)
                pcr = (b[0] << 25 | b[1] << 17 | b[2] << 9 | b[3] << 1 | b[4] >> 7) * 300 + ((b[4] & 1) << 8 | b[5])
            whole = pes[body : 6 + size] if size else pes[body:]
            out.units.append(Unit(k, pts, dts, pcr, bool(flags[r] & 0x40), not size or len(pes) >= 6 + size, whole))
    return out


def payload_of(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def pack_streams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 as a transport stream."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                texts = [(x or "").encode() for x in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([pack(payload_of(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_bytes long, media binary")


def read_units(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per access unit: id, pid, stream_type, program, unit, pts, dts, pcr, random_access, complete, data."""
    schema = "id long, pid int, stream_type int, program int, unit int, pts long, dts long, pcr long, random_access boolean, complete boolean, data binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "media"):
                rows = [
                    (i, u.pid, *s.streams[u.pid], k, u.pts, u.dts, u.pcr, u.random_access, u.complete, u.data)
                    for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                    for s in (parse(m),)
                    for k, u in enumerate(s.units)
                ]
                kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def feature_of(s: Stream) -> str:
    """Counts and timestamps of a stream as one string."""
    times = [u.pts for u in s.units if u.pts is not None]
    kinds = ",".join(f"{k:04x}:{t:02x}" for k, (t, _) in sorted(s.streams.items()))
    return (
        f"packets={s.n_packets};programs={len(s.programs)};streams={kinds};units={len(s.units)};"
        f"sync_losses={s.sync_losses};continuity_errors={s.continuity_errors};repeated={s.repeated};random_access={sum(u.random_access for u in s.units)};"
        f"pts={f'{times[0]}-{times[-1]}' if times else '-'};complete={sum(u.complete for u in s.units)}"
    )


def stream_digests(df: DataFrame) -> DataFrame:
    """Digests and features of (id, n_bytes, media) rows, all taken from the bytes read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "media"):
                rows = []
                for i, n, m in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    s = parse(m)
                    data = b"".join(u.data for u in s.units)
                    rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(s)))
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return df.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a transport stream and back."""
    return stream_digests(pack_streams(table(spark, sf_dir, "documents"), "doc_id", "text"))
