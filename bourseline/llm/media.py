"""Documents as MPEG transport streams in a binary column, and the way back.

The writer puts a payload into PES packets of at most ``unit`` bytes.  Every
unit begins with the program tables, carries a presentation timestamp, and its
first transport packet is a random-access point with a clock reference.  The
media table keeps, beside the stream, the timestamps and the byte offsets of
the random-access points, so that a reader can start at any unit.

The reader takes nothing from the writer but the stored bytes: it checks the
sync bytes, parses and checks the program tables, follows the continuity
counters of every PID and reassembles the elementary stream.

Null text is empty; a payload is padded with bytes 0 to a positive multiple of
64.  Equal texts give equal streams: the stream holds nothing of the row's
other columns.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
PMT_PID = 0x1000
ES_PID = 0x0100
UNIT = 16384
TICKS = 3600  # 90 kHz ticks of a unit: 25 units a second
PAD = 64

_MEDIA = "doc_id long, n_bytes long, media binary, pts array<long>, random_access array<long>"
_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def crc_mpeg(data: bytes) -> int:
    """CRC-32 as program tables use it: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = np.frombuffer(
    _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
    + _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")),
    np.uint8,
).reshape(2, PACKET)


def _stamp(ticks: int, mark: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 29) & 0x0E | 1, (ticks >> 22) & 0xFF, (ticks >> 14) & 0xFE | 1, (ticks >> 7) & 0xFF, (ticks << 1) & 0xFE | 1])


def mux(payload: bytes, unit: int = UNIT) -> tuple[bytes, list[int], list[int]]:
    """The stream of a payload, its units' timestamps and their byte offsets."""
    out, stamps, offsets = [], [], []
    size = counter = 0
    for number, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        ticks = number * TICKS
        pes = b"\x00\x00\x01\xbd" + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks, 2) + data
        m = 1 + max(0, -(-(len(pes) - 176) // 184))
        tables = _TABLES.copy()
        tables[:, 3] |= number & 0x0F
        packets = np.full((m, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(m)) & 0x0F
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        first = min(176, len(pes))
        packets[0, 4] = 183 - first
        packets[0, 5] = 0x50  # random access, clock reference
        packets[0, 6:12] = np.frombuffer((ticks << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        packets[0, PACKET - first :] = np.frombuffer(pes, np.uint8, first)
        if m > 1:
            body = np.frombuffer(pes, np.uint8)[first:]
            whole = (m - 2) * 184
            packets[1 : m - 1, 4:] = body[:whole].reshape(-1, 184)
            rest = len(body) - whole
            packets[m - 1, PACKET - rest :] = body[whole:]
            if rest < 184:
                packets[m - 1, 3] |= 0x20
                packets[m - 1, 4] = 183 - rest
                if rest < 183:
                    packets[m - 1, 5] = 0
        counter += m
        stamps.append(ticks)
        offsets.append(size + 2 * PACKET)
        out += [tables.tobytes(), packets.tobytes()]
        size += (m + 2) * PACKET
    return b"".join(out), stamps, offsets


def _checked(section: np.ndarray, table: int, known: dict[bytes, bool]) -> bytes:
    length = ((int(section[2]) & 0x0F) << 8 | int(section[3])) + 3
    data = section[1 : 1 + length].tobytes()
    if data not in known:
        known[data] = crc_mpeg(data) == 0
    if section[0] or data[0] != table or not known[data]:
        raise ValueError("a program table is damaged")
    return data


def demux(stream: bytes, known: dict[bytes, bool] | None = None) -> tuple[bytes, list[int], list[int]]:
    """Payload, timestamps and random-access offsets of a stream; raises ValueError on damage."""
    known = {} if known is None else known
    p = np.frombuffer(stream, np.uint8)
    if not p.size or p.size % PACKET:
        raise ValueError("not a whole number of packets")
    p = p.reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any() or (p[:, 1] & 0x80).any():
        raise ValueError("a sync byte is missing or a packet is marked as damaged")
    pid = (p[:, 1] & 0x1F).astype(np.int32) << 8 | p[:, 2]
    if (p[:, 3] & 0x10 == 0).any():
        raise ValueError("a packet has no payload")
    adapted = (p[:, 3] & 0x20) > 0
    begin = np.where(adapted, 5 + p[:, 4].astype(np.int32), 4)
    order = np.argsort(pid, kind="stable")
    same = pid[order][1:] == pid[order][:-1]
    step = (p[order, 3][1:].astype(np.int32) - p[order, 3][:-1]) & 0x0F
    if (step[same] != 1).any():
        raise ValueError("a continuity counter jumps")
    pat = np.flatnonzero(pid == 0)
    pmt_pids = {int.from_bytes(_checked(p[i, 4:], 0, known)[10:12], "big") & 0x1FFF for i in pat}
    streams = set()
    for i in np.flatnonzero(np.isin(pid, list(pmt_pids))):
        data = _checked(p[i, 4:], 2, known)
        at = 12 + ((data[10] & 0x0F) << 8 | data[11])
        while at < len(data) - 4:
            streams.add(int.from_bytes(data[at + 1 : at + 3], "big") & 0x1FFF)
            at += 5 + ((data[at + 3] & 0x0F) << 8 | data[at + 4])
    if len(streams) != 1:
        raise ValueError("one elementary stream is expected")
    own = np.flatnonzero(pid == streams.pop())
    es, at = p[own], begin[own]
    data = es[np.arange(PACKET) >= at[:, None]].tobytes()
    starts = np.concatenate([[0], np.cumsum(PACKET - at)])
    heads = np.flatnonzero(es[:, 1] & 0x40)
    if not heads.size or heads[0]:
        raise ValueError("the stream does not begin with a unit")
    parts, stamps = [], []
    for a, b in zip(starts[heads].tolist(), [*starts[heads[1:]].tolist(), len(data)], strict=True):
        length = int.from_bytes(data[a + 4 : a + 6], "big")
        if data[a : a + 3] != b"\x00\x00\x01" or a + 6 + length != b:
            raise ValueError("a unit is cut short")
        t = data[a + 9 : a + 14]
        stamps.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        parts.append(data[a + 9 + data[a + 8] : b])
    flags = adapted[own] & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0)
    return b"".join(parts), stamps, (own[flags] * PACKET).tolist()


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % PAD if data else PAD), len(data)


def features(payload: bytes, stamps: list[int], offsets: list[int], packets: int) -> str:
    """Figures of a stream as read back: packets, units, duration, access points, byte statistics."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum() / len(payload))
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return f"packets={packets};units={len(stamps)};last_pts={stamps[-1]};access_points={len(offsets)};mean={mean:.4f};entropy={entropy:.4f}"


def _mux_rows(unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                payload, n = padded(text)
                rows.append((doc, n, *mux(payload, unit)))
                held += len(payload)
                if held > 16_000_000:
                    yield _table(rows, _MEDIA)
                    rows, held = [], 0
            if rows:
                yield _table(rows, _MEDIA)

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, bool] = {}
    for batch in batches:
        rows = []
        docs, sizes, media = (batch.column(c) for c in ("doc_id", "n_bytes", "media"))
        points = batch.column("random_access").to_pylist()
        for i in range(batch.num_rows):
            stream = media[i].as_py()
            payload, stamps, offsets = demux(stream, known)
            if offsets != points[i]:
                raise ValueError("the stored random-access points are not those of the stream")
            rows.append((docs[i].as_py(), sizes[i].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), features(payload, stamps, offsets, len(stream) // PACKET)))
        yield _table(rows, _DIGEST)


def to_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, media (the stream), pts, random_access of every document."""
    return docs.select("doc_id", "text").mapInArrow(_mux_rows(unit), _MEDIA)


def write_media(docs: DataFrame, path: str, unit: int = UNIT) -> None:
    to_media(docs, unit).write.option("compression", "zstd").parquet(path)


def media_digest(media: DataFrame) -> DataFrame:
    """Read the streams of a media table back and compute digests and features."""
    return media.select("doc_id", "n_bytes", "media", "random_access").mapInArrow(_digest_rows, _DIGEST)


def read_from(media: DataFrame, ticks: int) -> DataFrame:
    """The rest of each stream from the last random-access point at or before a timestamp."""
    before = F.filter(F.arrays_zip("pts", "random_access"), lambda x: x["pts"] <= ticks)
    at = F.element_at(before, -1)["random_access"]
    return media.withColumn("media", F.expr(f"substring(media, CAST(element_at(filter(arrays_zip(pts, random_access), x -> x.pts <= {int(ticks)}), -1).random_access AS INT) + 1)")).withColumn("at", at)
