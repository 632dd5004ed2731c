"""Matroska media columns: write and parse EBML files, packets as rows.

The parser reads variable-length ids and sizes, clusters of known or unknown size, simple
blocks and block groups, Xiph, EBML and fixed lacing, and cues, and gives a packet table with
track, timestamp and byte range. It works on the stored bytes alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, table

# Fixed values of the public Matroska element specification.
EBML, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, TRACK_UID, BLOCK_DURATION = 0x4282, 0x73C5, 0x9B
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

FRAME = 192  # bytes: 24 ms of 8-bit mono sound at 8 kHz
LACED, BLOCKS_PER_CLUSTER, FRAME_MS = 8, 16, 24


class MediaError(ValueError):
    """The bytes are not a readable Matroska file."""


@dataclass
class Packet:
    cluster: int
    track: int
    timestamp_ns: int
    lace: int
    keyframe: bool
    offset: int
    length: int


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position
    tracks: dict[int, tuple[int, str]] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    doc_type: str = ""
    scale: int = 1_000_000


def vint(value: int, width: int = 0) -> bytes:
    """A size or signed-lace value in the fewest bytes, or in `width`."""
    if not width:
        width = 1
        while value >= (1 << (7 * width)) - 1:
            width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def _laced(frames: list[bytes], kind: int) -> bytes:
    if kind == NO_LACE:
        return frames[0]
    out = bytes([len(frames) - 1])
    if kind == XIPH:
        out += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == EBML_LACE:
        out += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d, width = len(b) - len(a), 1
            while abs(d) > (1 << (7 * width - 1)) - 1:
                width += 1
            out += vint(d + (1 << (7 * width - 1)) - 1, width)
    return out + b"".join(frames)


def write_matroska(payload: bytes, frame: int = FRAME) -> bytes:
    """One 8-bit PCM track; blocks of up to eight frames, whose lacing goes through all three kinds; a cue per cluster."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, element(TIMESTAMP_SCALE, _uint(1_000_000)))
    entry = element(TRACK_NUMBER, b"\1") + element(TRACK_UID, b"\1") + element(TRACK_TYPE, b"\2") + element(CODEC_ID, b"A_PCM/INT/LIT")
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, body)), []
    per_block, step = frame * LACED, frame * LACED * BLOCKS_PER_CLUSTER
    for c in range(0, len(payload), step):
        start_ms, blocks = c // frame * FRAME_MS, []
        for k, b in enumerate(range(c, min(c + step, len(payload)), per_block)):
            part = payload[b : b + per_block]
            n = -(-len(part) // frame)
            kind = NO_LACE if n == 1 else (XIPH, FIXED, EBML_LACE)[k % 3] if len(part) % frame == 0 else XIPH
            data = b"\x81" + (k * LACED * FRAME_MS).to_bytes(2, "big") + bytes([0x80 | kind << 1])
            if kind == FIXED:
                data += bytes([n - 1]) + part
            else:
                data += _laced([part[i : i + frame] for i in range(0, len(part), frame)], kind)
            blocks.append(element(SIMPLE_BLOCK, data))
        cluster = element(CLUSTER, element(CLUSTER_TIMESTAMP, _uint(start_ms)) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, _uint(start_ms)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, _uint(at)))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _ident(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise MediaError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise MediaError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _size(data: bytes, at: int) -> tuple[int | None, int, int]:
    """(value or None if unknown, next byte, width)."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError(f"cut size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") ^ 1 << (7 * width)
    return None if value == (1 << (7 * width)) - 1 else value, at + width, width


_TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML}


def _children(data: bytes, at: int, end: int, top: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end); an element of unknown size ends where its parent does, a cluster at the next top-level element."""
    while at < end:
        begin = at
        ident, at = _ident(data, at)
        size, at, _ = _size(data, at)
        if size is None:
            to = end
            if ident == CLUSTER and top:
                to = at
                while to < end:
                    inner, body = _ident(data, to)
                    if inner in _TOP:
                        break
                    n, body, _ = _size(data, body)
                    if n is None:
                        raise MediaError(f"unknown size inside a cluster at byte {to}")
                    to = body + n
        else:
            to = at + size
        if to > end:
            raise MediaError(f"element at byte {begin} passes its parent's end")
        yield ident, begin, at, to
        at = to


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    if kind == NO_LACE:
        return [(at, end - at)]
    if at >= end:
        raise MediaError(f"no lace count at byte {at}")
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise MediaError(f"uneven fixed lace at byte {at}")
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == XIPH:
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise MediaError(f"cut lace at byte {at}")
                size, at = size + data[at], at + 1
            else:
                value, at, width = _size(data, at)
                if value is None:
                    raise MediaError(f"unknown lace size at byte {at}")
                size = value if not k else sizes[-1] + value - (1 << (7 * width - 1)) + 1
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError(f"lace passes its block's end at byte {at}")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def parse_matroska(data: bytes) -> Media:
    m = Media()
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    for ident, _, a, b in _children(data, 0, len(data), True):
        if ident == EBML:
            m.doc_type = next((data[x:y].decode("ascii", "replace") for i, _, x, y in _children(data, a, b) if i == DOC_TYPE), "")
        if ident != SEGMENT:
            continue
        base = a
        for kind, begin, x, y in _children(data, a, b, True):
            if kind == INFO:
                m.scale = next((number(p, q) for i, _, p, q in _children(data, x, y) if i == TIMESTAMP_SCALE), m.scale)
            elif kind == TRACKS:
                for i, _, p, q in _children(data, x, y):
                    if i == TRACK_ENTRY:
                        own = {j: data[r:s] for j, _, r, s in _children(data, p, q)}
                        m.tracks[int.from_bytes(own.get(TRACK_NUMBER, b""), "big")] = (int.from_bytes(own.get(TRACK_TYPE, b""), "big"), own.get(CODEC_ID, b"").decode("ascii", "replace"))
            elif kind == CLUSTER:
                _cluster(data, x, y, len(m.clusters), m)
                m.clusters.append(begin - base)
            elif kind == CUES:
                for i, _, p, q in _children(data, x, y):
                    if i == CUE_POINT:
                        time, places = 0, []
                        for j, _, r, s in _children(data, p, q):
                            if j == CUE_TIME:
                                time = number(r, s)
                            elif j == CUE_POSITIONS:
                                own = {k: number(t, u) for k, _, t, u in _children(data, r, s)}
                                places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, -1)))
                        m.cues += [(time, *x) for x in places]
    if not m.doc_type:
        raise MediaError("no EBML header")
    return m


def _cluster(data: bytes, at: int, end: int, index: int, m: Media) -> None:
    time = 0
    for ident, _, a, b in _children(data, at, end):
        if ident == CLUSTER_TIMESTAMP:
            time = int.from_bytes(data[a:b], "big")
            continue
        key = None
        if ident == BLOCK_GROUP:
            ident, a, b, key = next(((BLOCK, x, y, True) for i, _, x, y in _children(data, a, b) if i == BLOCK), (0, a, b, None))
        if ident not in (SIMPLE_BLOCK, BLOCK):
            continue
        track, p, _ = _size(data, a)
        if track is None or p + 3 > b:
            raise MediaError(f"cut block at byte {a}")
        relative, flags = int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
        for k, (offset, size) in enumerate(_frames(data, p + 3, b, flags >> 1 & 3)):
            m.packets.append(Packet(index, track, (time + relative) * m.scale, k, bool(flags & 128) if key is None else key, offset, size))


PACKET_SCHEMA = "file_id bigint, packet int, cluster int, track int, timestamp_ns bigint, lace int, keyframe boolean, byte_offset bigint, n_bytes bigint, error string"
_PACKET_TYPES = pa.schema([("file_id", pa.int64()), ("packet", pa.int32()), ("cluster", pa.int32()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("lace", pa.int32()), ("keyframe", pa.bool_()), ("byte_offset", pa.int64()), ("n_bytes", pa.int64()), ("error", pa.string())])


def media_packets(files: DataFrame, id_col: str = "file_id", media_col: str = "media") -> DataFrame:
    """Packet table of a column of Matroska files: one row per frame, in file order.

    A null or empty file gives no rows. A file that can't be read gives one row with `error` set
    and null packet columns. Repeated rows give repeated packets; a null id stays null.
    """

    def rows(batch: pa.RecordBatch):
        for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not data:
                continue
            try:
                ps = parse_matroska(data).packets
            except MediaError as e:
                yield {n: [ident if n == "file_id" else str(e) if n == "error" else None] for n in _PACKET_TYPES.names}
                continue
            for a in range(0, len(ps), 20_000):
                own = ps[a : a + 20_000]
                yield {"file_id": [ident] * len(own), "packet": list(range(a, a + len(own))), "cluster": [p.cluster for p in own], "track": [p.track for p in own], "timestamp_ns": [p.timestamp_ns for p in own], "lace": [p.lace for p in own], "keyframe": [p.keyframe for p in own], "byte_offset": [p.offset for p in own], "n_bytes": [p.length for p in own], "error": [None] * len(own)}

    return arrow_map(files.select(F.col(id_col).cast("long").alias("file_id"), F.col(media_col).alias("media")), rows, PACKET_SCHEMA, _PACKET_TYPES)


def text_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file_id, n_bytes, media binary: each text as UTF-8, filled with blanks to a positive multiple of 192, as a Matroska file.

    Null and empty texts become one frame of blanks. A very long text is one value, so it has to fit a row with its file. One row per
    input row, repeated rows too; no rows give no rows; other columns are ignored. Ids are whole numbers, or texts of digits.
    """
    types = pa.schema([("file_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batch: pa.RecordBatch):
        for a, b in byte_slices(batch.column(1)):
            made = [text_payload(x) for x in batch.column(1).slice(a, b - a).to_pylist()]
            yield {"file_id": batch.column(0).slice(a, b - a), "n_bytes": [n for n, _ in made], "media": [write_matroska(p) for _, p in made]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("file_id"), text_col), rows, "file_id bigint, n_bytes bigint, media binary", types)


def feature_of(m: Media, payload: bytes) -> str:
    last = m.packets[-1] if m.packets else Packet(0, 0, 0, 0, False, 0, 0)
    laced = len({(p.cluster, p.timestamp_ns) for p in m.packets})
    at = {c: i for i, c in enumerate(m.clusters)}
    cued = sum(position in at for _, _, position in m.cues)
    mean = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) * 1000 // max(1, len(payload))
    return f"tracks={len(m.tracks)};clusters={len(m.clusters)};cues={cued};blocks={laced};packets={len(m.packets)};end_ms={last.timestamp_ns // 1_000_000 + (last.lace + 1) * FRAME_MS if m.packets else 0};mean_milli={mean}"


def media_digest(files: DataFrame) -> DataFrame:
    """Digests of what the packet table of each file holds, read back from the stored bytes; null where a file can't be read. Very long files are read whole, one row each."""
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(n: int, data: bytes) -> tuple:
        try:
            m = parse_matroska(data or b"")
        except MediaError:
            return n, None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None
        payload = b"".join([data[p.offset : p.offset + p.length] for p in m.packets])
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(m, payload)

    def rows(batch: pa.RecordBatch):
        made = [one(n.as_py(), d.as_py()) for n, d in zip(batch.column(1), batch.column(2), strict=True)]
        yield {"doc_id": batch.column(0)} | {name: [x[k] for x in made] for k, name in enumerate(types.names[1:])}

    return arrow_map(files.select("file_id", "n_bytes", "media"), rows, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", types)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_digest(text_to_media(table(spark, sf_dir, "documents")))
