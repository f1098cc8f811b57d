"""Matroska columns: EBML elements, clusters, lacing and cues as tables of packets.

read() walks the elements of a file held in a column: variable-length ids and sizes, elements of unknown size,
SimpleBlocks and BlockGroups with Xiph, fixed-size or EBML lacing, and the cues. Every packet gets its track,
timestamp and byte range, so that payloads are slices of the column. mux() writes such files with one PCM track of
8-bit samples.

Defined cases: a null or empty text has the payload of 64 zero bytes; equal payloads give equal files; an empty table
gives an empty result; bytes that are no Matroska file, or end early, give the packets found before that; other
columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ids_and_texts, map_arrow

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, NUMBER, CODEC, DEFAULT_DURATION, AUDIO, RATE = 0x2AD7B1, 0x4489, 0xD7, 0x86, 0x23E383, 0xE1, 0xB5
TIME, SIMPLE, GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE_POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = frozenset({SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_AT})
#: What ends a cluster of unknown size.
_TOP = frozenset({CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367})

RATE_HZ, FRAME, LACED, BLOCKS = 8000, 512, 8, 16
"""Samples a second, samples of a packet, packets of a block, blocks of a cluster that mux() writes."""


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    block: int
    lace: int


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # (timestamp_ns, track, absolute offset of the cluster)
    clusters: list[int]
    duration_ns: int


def _vint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """A size at a position: (value, position after it); -1 for unknown."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > end:
        raise IndexError(at)
    value = int.from_bytes(data[at : at + n], "big") - (1 << 7 * n)
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(id, start of the content, its end or -1 if unknown)."""
    n = 9 - data[at].bit_length()
    if n > 4 or at + n >= end:
        raise IndexError(at)
    size, start = _vint(data, at + n, end)
    return int.from_bytes(data[at : at + n], "big"), start, -1 if size < 0 else start + size


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the packets of a block whose header ends at a position."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes = []
    if kind == 2:
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        for k in range(n - 1):
            width = 9 - data[at].bit_length()
            value, at = _vint(data, at, end)
            value = (1 << 7 * width) - 1 if value < 0 else value
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise IndexError(at)
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def read(data: bytes) -> Media:
    """Tracks, packets and cues of a file."""
    media = Media({}, [], [], [], 0)
    scale, duration, segment, cluster_time, blocks = 1_000_000, 0.0, 0, 0, 0
    track: dict = {}
    cue: dict = {}
    group: dict = {}

    def block(start: int, end: int, simple: bool, keyframe: bool = True) -> None:
        nonlocal blocks
        number, at = _vint(data, start, end)
        (relative,) = struct.unpack_from(">h", data, at)
        flags = data[at + 2]
        keyframe = bool(flags & 0x80) if simple else keyframe
        time = (cluster_time + relative) * scale
        step = media.tracks.get(number, {}).get("default_duration", 0)
        rate = media.tracks.get(number, {}).get("rate", 0)
        for k, (offset, size) in enumerate(_laces(data, at + 3, end, flags >> 1 & 3)):
            media.packets.append(Packet(number, time, offset, size, keyframe, blocks, k))
            time += step or (int(size * 1_000_000_000 // rate) if rate else 0)
        blocks += 1

    def walk(at: int, end: int, parent: int) -> int:
        nonlocal scale, duration, segment, cluster_time, track, cue, group
        while at < end:
            kind, start, stop = _element(data, at, end)
            if parent == CLUSTER and kind in _TOP:
                return at  # a cluster of unknown size ends here
            known = stop >= 0
            stop = min(stop, end) if known else end
            if kind in _PARENTS:
                if kind == SEGMENT:
                    segment = start
                elif kind == TRACK:
                    track = {}
                elif kind == CLUSTER:
                    media.clusters.append(at)
                elif kind == GROUP:
                    group = {"reference": False}
                elif kind == CUE_POINT:
                    cue = {}
                stop = walk(start, stop, kind)
                if kind == TRACK and NUMBER in track:
                    media.tracks[track[NUMBER]] = {"codec": track.get(CODEC, ""), "rate": track.get(RATE, 0), "default_duration": track.get(DEFAULT_DURATION, 0)}
                elif kind == GROUP and "block" in group:
                    block(*group["block"], False, not group["reference"])
                elif kind == CUE_AT and {CUE_TIME, CUE_TRACK, CUE_CLUSTER} <= cue.keys():
                    media.cues.append((cue[CUE_TIME] * scale, cue[CUE_TRACK], segment + cue[CUE_CLUSTER]))
            elif kind == SIMPLE:
                block(start, stop, True)
            elif kind == BLOCK:
                group["block"] = (start, stop)
            elif kind == REFERENCE:
                group["reference"] = True
            elif kind == TIME:
                cluster_time = int.from_bytes(data[start:stop], "big")
            elif kind == SCALE:
                scale = int.from_bytes(data[start:stop], "big")
            elif kind == DURATION:
                (duration,) = struct.unpack(">d" if stop - start == 8 else ">f", data[start:stop])
            elif kind in (NUMBER, DEFAULT_DURATION):
                track[kind] = int.from_bytes(data[start:stop], "big")
            elif kind == CODEC:
                track[kind] = data[start:stop].decode("ascii", "replace")
            elif kind == RATE:
                (track[kind],) = struct.unpack(">d" if stop - start == 8 else ">f", data[start:stop])
            elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[kind] = int.from_bytes(data[start:stop], "big")
            at = stop
        return at

    try:
        walk(0, len(data), 0)
    except (IndexError, struct.error):
        pass  # the file ends early: what was found stays
    return media._replace(duration_ns=int(duration * scale))


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _node(kind: int, *parts: bytes) -> bytes:
    content = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _uint(kind: int, value: int) -> bytes:
    return _node(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = _node(EBML, _uint(0x4286, 1), _uint(0x42F7, 1), _uint(0x42F2, 4), _uint(0x42F3, 8), _node(0x4282, b"matroska"), _uint(0x4287, 4), _uint(0x4285, 2))
_TRACKS = _node(
    TRACKS,
    _node(TRACK, _uint(NUMBER, 1), _uint(0x73C5, 1), _uint(0x83, 2), _uint(0x9C, 1), _node(CODEC, b"A_PCM/INT/LIT"), _node(AUDIO, _node(RATE, struct.pack(">d", RATE_HZ)), _uint(0x9F, 1), _uint(0x6264, 8))),
)


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Flag bits and the laced content: none for one packet, fixed for equal sizes, else EBML."""
    if len(frames) == 1:
        return 0, frames[0]
    count = bytes([len(frames) - 1])
    if len({*map(len, frames)}) == 1:
        return 2 << 1, count + b"".join(frames)
    sizes = [len(f) for f in frames]
    head = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while abs(b - a) >= (1 << 7 * width - 1) - 1:
            width += 1
        head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return 3 << 1, count + head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file with the payload as 8-bit samples."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _node(INFO, _uint(SCALE, 1_000_000), _node(DURATION, struct.pack(">d", len(payload) * 1000 / RATE_HZ)), _node(0x4D80, b"arborquery"), _node(0x5741, b"arborquery"))
    parts, points, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    span = LACED * BLOCKS
    for c in range(0, len(frames), span):
        start = c * FRAME * 1000 // RATE_HZ
        blocks = [_uint(TIME, start)]
        for b in range(c, min(c + span, len(frames)), LACED):
            flags, content = _lace(frames[b : min(b + LACED, c + span)])
            blocks.append(_node(SIMPLE, b"\x81", struct.pack(">hB", b * FRAME * 1000 // RATE_HZ - start, 0x80 | flags), content))
        cluster = _node(CLUSTER, *blocks)
        points.append(_node(CUE_POINT, _uint(CUE_TIME, start), _node(CUE_AT, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + _node(SEGMENT, *parts, _node(CUES, *points))


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def muxed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, in a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.as_py().encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array([mux(padded(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(ids_and_texts(docs), run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: track, timestamp, byte range, key frame flag, block and place in its lacing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if m.is_valid for p in read(m.as_py()).packets]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()), strict=True)],
                ["id", "track", "timestamp_ns", "offset", "size", "keyframe", "block", "lace"],
            )

    return map_arrow(media.select(media[id_col].cast("long").alias("id"), media[media_col].alias("media")), run, "id long, track int, timestamp_ns long, offset long, size long, keyframe boolean, block int, lace int")


def features(media: Media, payload: bytes) -> str:
    """Packets, blocks, clusters, cues, duration, mean, power, sign changes and 8 histogram bins of the samples."""
    x = np.frombuffer(payload, np.uint8)
    wide = x.astype(np.int64)
    changes = int(np.count_nonzero(np.diff(x >= 128)))
    bins = np.bincount(x >> 5, minlength=8)
    blocks = media.packets[-1].block + 1 if media.packets else 0
    return f"p{len(media.packets)};b{blocks};c{len(media.clusters)};q{len(media.cues)};d{media.duration_ns};s{int(wide.sum())};e{int((wide * wide).sum())};z{changes};h{','.join(map(str, bins.tolist()))}"


def read_back(media: DataFrame) -> DataFrame:
    """Payload digests and features, from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for m in batch.column(2):
                data = m.as_py()
                found = read(data)
                payload = b"".join([data[p.offset : p.offset + p.size] for p in found.packets])
                for c, v in zip(out, (len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(data), sha256(data).hexdigest(), features(found, payload)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return map_arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as samples in a media column, read back from it."""
    return read_back(muxed(documents(spark, sf_dir)))
