"""Matroska media columns: EBML elements, clusters, lacing and cues, written from and read into packet tables.

Only the container is handled; frames stay bytes. The reader takes variable-length ids and sizes, elements of
unknown size, simple blocks and block groups, the four kinds of lacing, and cues.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA3, 0xA0, 0xA1, 0xBB, 0xB7
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, KIND, LACES, CODEC, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER_TIME, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xB3, 0xF7, 0xF1
VERSIONS = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8))
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
CONTAINERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: An element of unknown size ends where one of these begins.
_TOP = {INFO, TRACKS, CLUSTER, CUES}

FRAME = 192
#: 8-bit samples a second, so a frame lasts 24 ms.
SAMPLE_RATE = 8000
_FRAME_MS = FRAME * 1000 // SAMPLE_RATE
_LACED, _CLUSTER_BLOCKS = 8, 64
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


# Writing


def size_bytes(n: int) -> bytes:
    """A variable-length size; all ones are kept for 'unknown'."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(code: int, data: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + size_bytes(len(data)) + data


def unsigned(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(code: int, x: float) -> bytes:
    return element(code, struct.pack(">d", x))


def block_bytes(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A block's content: track, relative time, flags (key frame) and the frames, laced as asked."""
    if len(frames) == 1:
        lacing = NO_LACING
    head = size_bytes(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    sizes = b""
    lengths = [len(f) for f in frames]
    if lacing == XIPH:
        sizes = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in lengths[:-1])
    elif lacing == EBML_LACING:
        sizes = size_bytes(lengths[0])
        for before, n in zip(lengths, lengths[1:-1], strict=False):
            width = 1
            while not -((1 << (7 * width - 1)) - 1) < n - before < (1 << (7 * width - 1)) - 1:
                width += 1
            sizes += (n - before + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    elif len(set(lengths)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + bytes([len(frames) - 1]) + sizes + b"".join(frames)


_HEADER = element(EBML, b"".join(unsigned(c, v) for c, v in VERSIONS) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ, 2))
_AUDIO_TRACK = element(TRACKS, element(TRACK_ENTRY, unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + unsigned(LACES, 1) + unsigned(DEFAULT_DURATION, _FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, real(RATE, float(SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))))


def write_audio(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples: frames of 192 bytes, blocks of up to eight frames whose lacing takes
    turns, clusters of up to 64 blocks with a cue each."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, float(len(frames) * _FRAME_MS)) + element(MUXER, b"judgelake") + element(WRITER, b"judgelake"))
    body, cues, at = [info, _AUDIO_TRACK], [], len(info) + len(_AUDIO_TRACK)
    per_cluster = _LACED * _CLUSTER_BLOCKS
    for first in range(0, len(frames), per_cluster):
        blocks = []
        for k in range(first, min(first + per_cluster, len(frames)), _LACED):
            laced = frames[k : k + _LACED]
            content = block_bytes(1, (k - first) * _FRAME_MS, laced, (XIPH, FIXED, EBML_LACING)[k // _LACED % 3])
            blocks.append(element(SIMPLE_BLOCK, content) if k // _LACED % 4 else element(BLOCK_GROUP, element(BLOCK, content)))
        cluster = element(CLUSTER, unsigned(CLUSTER_TIME, first * _FRAME_MS) + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, first * _FRAME_MS) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


# Reading


def read_vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and the place behind it; keep leaves the length marker in (as ids do). An unknown
    size is -1."""
    first = data[at]
    if not first:
        raise ValueError("no element here")
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("cut short")
    if not keep:
        value &= (1 << (7 * width)) - 1
        value = -1 if value == (1 << (7 * width)) - 1 else value
    return value, at + width


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the contents of the elements between two places."""
    while at < end:
        code, here = read_vint(data, at, True)
        size, here = read_vint(data, here, False)
        stop = here + size
        if size < 0:
            stop = end
            for inner, start, _ in elements(data, here, end, code) if code == CLUSTER else ():
                if inner in _TOP:  # begins behind the cluster: step back over its head
                    stop = data.rindex(inner.to_bytes(4, "big"), here, start)
                    break
        yield code, here, min(stop, end)
        at = stop


def frames_of(data: bytes, start: int, end: int) -> tuple[int, int, bool, int, list[tuple[int, int]]]:
    """Of a block: track, relative time, key flag, lacing, and (offset, size) of each frame in data."""
    track, at = read_vint(data, start, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, bool(flags & 0x80), lacing, [(at, end - at)]
    count = data[at] + 1
    at += 1
    if lacing == FIXED:
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == XIPH:
                n = 0
                while data[at] == 255:
                    n += 255
                    at += 1
                sizes.append(n + data[at])
                at += 1
            elif k == 0:
                n, at = read_vint(data, at, False)
                sizes.append(n)
            else:
                width = 9 - data[at].bit_length()
                value = int.from_bytes(data[at : at + width], "big") & (1 << (7 * width)) - 1
                sizes.append(sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
                at += width
        sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, bool(flags & 0x80), lacing, out


def read_file(data: bytes) -> dict:
    """Tracks, packets (track, timestamp in ms, key, lacing, offset, size), cues (ms, track, cluster offset), the
    duration in ms and the number of clusters. A block's time is its first frame's; the other frames of a lace follow by
    the track's default duration, or share that time where the track has none."""
    found = {"tracks": [], "packets": [], "cues": [], "duration": 0.0, "clusters": 0}
    scale, segment, lasts = 1_000_000, 0, {}
    number = lambda s, e: int.from_bytes(data[s:e], "big")
    float_ = lambda s, e: struct.unpack(">d" if e - s == 8 else ">f", data[s:e])[0]
    for code, s, e in elements(data, 0, len(data)):
        if code != SEGMENT:
            continue
        segment = s
        for top, s1, e1 in elements(data, s, e):
            if top == INFO:
                for k, a, b in elements(data, s1, e1):
                    scale = number(a, b) if k == TIMESTAMP_SCALE else scale
                    found["duration"] = float_(a, b) if k == DURATION else found["duration"]
            elif top == TRACKS:
                for k, a, b in elements(data, s1, e1):
                    if k == TRACK_ENTRY:
                        own = {i: (x, y) for i, x, y in elements(data, a, b)}
                        lasts[number(*own[NUMBER])] = number(*own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0
                        found["tracks"].append({"number": number(*own[NUMBER]), "kind": number(*own[KIND]), "codec": data[slice(*own[CODEC])].decode("ascii", "replace")})
            elif top == CLUSTER:
                found["clusters"] += 1
                base = 0
                for k, a, b in elements(data, s1, e1):
                    if k == CLUSTER_TIME:
                        base = number(a, b)
                        continue
                    if k == BLOCK_GROUP:
                        k, a, b = next(((i, x, y) for i, x, y in elements(data, a, b) if i == BLOCK), (0, 0, 0))
                    if k in (SIMPLE_BLOCK, BLOCK):
                        track, relative, key, lacing, frames = frames_of(data, a, b)
                        at, step = (base + relative) * scale, lasts.get(track, 0)
                        found["packets"].extend((track, (at + j * step) // 1_000_000, key or k == BLOCK, lacing, offset, n) for j, (offset, n) in enumerate(frames))
            elif top == CUES:
                for k, a, b in elements(data, s1, e1):
                    own = {i: (x, y) for i, x, y in elements(data, a, b)} if k == CUE_POINT else {}
                    if CUE_TIME in own and CUE_POSITIONS in own:
                        where = {i: number(x, y) for i, x, y in elements(data, *own[CUE_POSITIONS])}
                        found["cues"].append((number(*own[CUE_TIME]), where.get(CUE_TRACK), segment + where.get(CUE_CLUSTER, 0)))
    return found


# Tables

#: What damaged bytes raise when they are read.
_DAMAGED = (ValueError, IndexError, KeyError, struct.error)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as UTF-8, padded with spaces to a positive multiple of
    192 bytes, as a file of 8-bit samples. Other columns are ignored; repeated rows give repeated files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                media = [write_audio(t.ljust(max(1, -(-len(t) // FRAME)) * FRAME)) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, timestamp_ms, key, lacing, offset, size. Null media and bytes that are
    no such file have no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            ids, rows = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = read_file(data.as_py() or b"")["packets"]
                except _DAMAGED:
                    found = []
                ids.extend([key] * len(found))
                rows.extend((n, *p) for n, p in enumerate(found))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "packet", "track", "timestamp_ms", "key", "lacing", "offset", "size"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, packet int, track long, timestamp_ms long, key boolean, lacing int, offset long, size long")


def media_digests(media: DataFrame) -> DataFrame:
    """Of each stored file: what its packets hold when read back, and features of the samples and the container: how many
    cues lead to a cluster, and whether the packets follow each other in time, one frame apart. Null media and bytes that are no
    such file give nulls; of a file that is cut short, what can be read counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in (m.as_py() for m in batch.column(2)):
                try:
                    found = read_file(data or b"")
                    codec = found["tracks"][0]["codec"]
                except _DAMAGED:
                    rows.append((None,) * 6)
                    continue
                payload = b"".join(data[offset : offset + n] for _, _, _, _, offset, n in found["packets"])
                samples = np.frombuffer(payload, dtype=np.uint8)
                in_time = all(p[1] == k * _FRAME_MS for k, p in enumerate(found["packets"]))
                at_cues = sum(data[where : where + 4] == CLUSTER.to_bytes(4, "big") for _, _, where in found["cues"])
                feature = f"{codec};ms={found['duration']:.0f};clusters={found['clusters']};cues={at_cues};packets={len(found['packets'])};in_time={int(in_time)};mean={samples.mean() if len(samples) else 0:.4f};peak={samples.max(initial=0)};steps={int(np.abs(np.diff(samples.astype(np.int16))).sum())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
