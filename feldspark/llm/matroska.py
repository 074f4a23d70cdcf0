"""Matroska files as columns: parsing to packet tables, and a plain muxer to make such files.

The parser reads EBML elements of variable length (sizes known or not), tracks, clusters, SimpleBlocks and
BlockGroups with every kind of lacing, and cues; it gives a packet for each frame with its track, timestamp
and byte range. Broken files, of whatever kind, raise ValueError in parse(); in packet tables they give no packet and a reason.
Null or empty files: no packet, reason "empty".
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, stored

# Element ids of EBML and Matroska.
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, LACES, EACH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, LENGTH = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK, TAGS, CHAPTERS, ATTACHED = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: What may follow a segment's element of unknown size.
TOP = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS, CHAPTERS, ATTACHED))
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Bytes of a frame, frames laced into a block, blocks of a cluster, ticks of a frame in what mux() writes for a payload.
FRAME, LACED, BLOCKS, TICKS = 576, 8, 16, 72
#: Everything is put up to a positive multiple of this before it is stored.
MULTIPLE = 576


class Packet(NamedTuple):
    track: int
    timestamp: int
    keyframe: bool
    start: int
    end: int
    lacing: int


class Media(NamedTuple):
    doctype: str
    scale: int
    duration: float
    tracks: dict[int, str]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: int


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, next position, all ones) of the variable-length integer at `at`; keep: with its marker, as ids have it."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"the integer at {at} is cut off")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << 7 * n) - 1)
    return (raw if keep else value), at + n, value == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end of the body) of the elements in [at, end). One of unknown size ends where a top element begins that is no part of it."""
    while at < end:
        kind, body, _ = vint(data, at, keep=True)
        size, body, unknown = vint(data, body)
        stop = body + size
        if unknown:
            stop = end if kind == SEGMENT else _until(data, body, end)
        if stop > end:
            raise ValueError(f"element {kind:X} at {at} ends beyond its parent")
        yield kind, body, stop
        at = stop


def _until(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body, _ = vint(data, at, keep=True)
        if kind in TOP:
            return at
        size, body, unknown = vint(data, body)
        at = end if unknown else body + size
    return end


def unsigned(data: bytes, start: int, end: int) -> int:
    if end - start > 8:
        raise ValueError(f"an integer of {end - start} bytes at {start}")
    return int.from_bytes(data[start:end], "big")


def real(data: bytes, start: int, end: int) -> float:
    form = {0: "", 4: ">f", 8: ">d"}.get(end - start)
    if form is None:
        raise ValueError(f"a real number of {end - start} bytes at {start}")
    return struct.unpack(form, data[start:end])[0] if form else 0.0


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end)]
    if at >= end:
        raise ValueError("a laced block without a count")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed lacing of unequal frames")
        return [(at + k * size, at + (k + 1) * size) for k in range(count)]
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise ValueError("lacing is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            begin = at
            value, at, _ = vint(data, at)
            size = value if not k else sizes[-1] + value - ((1 << (7 * (at - begin) - 1)) - 1)
        if size < 0:
            raise ValueError("a negative frame size")
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if sizes[-1] < 0:
        raise ValueError("frames beyond their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def _block(data: bytes, start: int, end: int, base: int, keyframe: bool | None, each: dict[int, float]) -> Iterator[Packet]:
    """each: ticks of a frame by track, where the track tells; laced frames follow one another by it."""
    track, at, _ = vint(data, start)
    if at + 3 > end:
        raise ValueError("a block without its head")
    offset, flags = struct.unpack(">hB", data[at : at + 3])
    key = bool(flags & 0x80) if keyframe is None else keyframe
    lacing = flags >> 1 & 3
    for k, (first, last) in enumerate(_laced(data, at + 3, end, lacing)):
        yield Packet(track, base + offset + round(k * each.get(track, 0)), key, first, last, lacing)


def parse(data: bytes) -> Media:
    doctype, scale, duration, clusters = "", 1_000_000, 0.0, 0
    tracks: dict[int, str] = {}
    each: dict[int, float] = {}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    for top, start, end in elements(data, 0, len(data)):
        if top == EBML:
            for kind, a, b in elements(data, start, end):
                if kind == DOCTYPE:
                    doctype = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        if top != SEGMENT:
            continue
        for part, a, b in elements(data, start, end):
            if part == INFO:
                for kind, c, d in elements(data, a, b):
                    scale = unsigned(data, c, d) if kind == SCALE else scale
                    if not scale:
                        raise ValueError("a scale of 0")
                    duration = real(data, c, d) if kind == DURATION else duration
            elif part == TRACKS:
                for kind, c, d in elements(data, a, b):
                    if kind == TRACK:
                        own = {k: (e, f) for k, e, f in elements(data, c, d)}
                        codec = own.get(CODEC, (0, 0))
                        number = unsigned(data, *own.get(NUMBER, (0, 0)))
                        tracks[number] = data[slice(*codec)].decode("ascii", "replace")
                        if EACH in own:
                            each[number] = unsigned(data, *own[EACH]) / scale
            elif part == CLUSTER:
                clusters, base = clusters + 1, 0
                for kind, c, d in elements(data, a, b):
                    if kind == TIME:
                        base = unsigned(data, c, d)
                    elif kind == SIMPLE:
                        packets += _block(data, c, d, base, None, each)
                    elif kind == GROUP:
                        own = {k: (e, f) for k, e, f in elements(data, c, d)}
                        if BLOCK in own:
                            packets += _block(data, *own[BLOCK], base, 0xFB not in own, each)
            elif part == CUES:
                for kind, c, d in elements(data, a, b):
                    if kind == POINT:
                        at = 0
                        for k, e, f in elements(data, c, d):
                            if k == CUE_TIME:
                                at = unsigned(data, e, f)
                            elif k == POSITIONS:
                                own = {x: unsigned(data, y, z) for x, y, z in elements(data, e, f)}
                                cues.append((at, own.get(CUE_TRACK, 0), start + own.get(CUE_CLUSTER, 0)))
    return Media(doctype, scale, duration, tracks, packets, cues, clusters)


def size_of(n: int) -> bytes:
    """n as a variable-length integer of the fewest bytes that isn't all ones."""
    for k in range(1, 9):
        if n < (1 << 7 * k) - 1:
            return (n | 1 << 7 * k).to_bytes(k, "big")
    raise ValueError("too large")


def element(kind: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode("ascii")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_of(len(body)) + body


def lace(frames: list[bytes], lacing: int) -> bytes:
    """Frames as the body of a block after its flags."""
    if not lacing:
        (only,) = frames
        return only
    out = bytes([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            out += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == 3 and len(frames) > 1:
        out += size_of(len(frames[0]))
        for x, y in zip(frames, frames[1:-1], strict=False):
            d = len(y) - len(x)
            n = next(n for n in range(1, 9) if -(1 << 7 * n - 1) < d < (1 << 7 * n - 1))
            out += (d + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return out + b"".join(frames)


_HEAD = element(EBML, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(DOCTYPE, "matroska") + element(0x4287, 4) + element(0x4285, 2))
_TRACK = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(TYPE, 2) + element(EACH, TICKS * 1_000_000) + element(LACES, 1) + element(CODEC, "A_PCM/INT/LIT") + element(AUDIO, element(RATE, 8000.0) + element(CHANNELS, 1) + element(DEPTH, 8))))


def mux(payload: bytes, lacing: int | None = None) -> bytes:
    """payload as 8-bit samples of one track: frames laced into blocks, blocks in clusters, a cue for each cluster.

    lacing None: fixed for blocks of equal frames, else EBML; a single frame isn't laced.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    parts = [element(INFO, element(SCALE, 1_000_000) + element(DURATION, float(TICKS * len(frames)))), _TRACK]
    at, cues = sum(map(len, parts)), []
    per = LACED * BLOCKS
    for first in range(0, len(frames), per):
        body = [element(TIME, first * TICKS)]
        for k in range(first, min(first + per, len(frames)), LACED):
            own = frames[k : min(k + LACED, first + per)]
            kind = 0 if len(own) == 1 else lacing if lacing is not None else 2 if len(own[-1]) == len(own[0]) else 3
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (k - first) * TICKS, 0x80 | kind << 1) + lace(own, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(POINT, element(CUE_TIME, first * TICKS) + element(POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with bytes 255 up to a positive multiple of MULTIPLE."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (MULTIPLE - len(raw) if not raw else -len(raw) % MULTIPLE)


#: Timestamps lie within this; rows of a packet table in a batch.
LIMIT, ROWS = 1 << 62, 10_000
PACKETS = "reason string, track long, packet long, timestamp long, keyframe boolean, lacing string, byte_start long, byte_end long"


def packet_rows(data: bytes | None) -> tuple[Media | None, list[tuple]]:
    """(what parse() found, rows of the packet table) of a file; one row with the reason if there is no packet."""
    none = [None] * 7
    if not data:
        return None, [("empty", *none)]
    try:
        media = parse(data)
    except ValueError as error:
        return None, [(str(error), *none)]
    if any(not -LIMIT <= p.timestamp < LIMIT for p in media.packets):
        return None, [("a timestamp out of range", *none)]
    rows = [(None, p.track, k, p.timestamp, p.keyframe, LACINGS[p.lacing], p.start, p.end) for k, p in enumerate(media.packets)]
    return media, rows or [("no packet", *none)]


def packet_table(files: DataFrame, media: str = "media") -> DataFrame:
    """A row for each packet of the binary column `media` (a row with a reason for a file without any), beside the other columns.

    timestamp is in units of the file's scale; [byte_start, byte_end) is the frame in the file. Columns of files
    that bear a name of the packet table are left out. Packets of a file of any length come in batches of rows.
    """
    small_batches(files.sparkSession)
    own = [x.split()[0] for x in PACKETS.split(", ")]
    kept = [c for c in files.columns if c != media and c not in own]
    schema = files.select(*[f"`{c}`" for c in kept]).schema
    for x in PACKETS.split(", "):
        schema.add(*x.split())
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(b.num_columns - 1).to_pylist()):
                every = packet_rows(data)[1]
                for first in range(0, len(every), ROWS):
                    rows = every[first : first + ROWS]
                    left = b.select(kept).take(pa.array([i] * len(rows), pa.int64())) if kept else None
                    right = [pa.array([r[k] for r in rows], types[x.split()[1]]) for k, x in enumerate(PACKETS.split(", "))]
                    yield pa.RecordBatch.from_arrays([*(left.columns if left else []), *right], names=[*kept, *own])

    return files.select(*[f"`{c}`" for c in kept], F.col(f"`{media}`").cast("binary").alias("__media")).mapInArrow(run, schema)


def feature(media: Media, packets: list[tuple], payload: bytes) -> str:
    """Counts and durations from the packet table and the cues, with the mean and the zero crossings of the samples."""
    high = np.frombuffer(payload, np.uint8) >= 128
    crossed = np.count_nonzero(high[1:] != high[:-1])
    kinds = ",".join(f"{name}:{n}" for name in LACINGS if (n := sum(p[5] == name for p in packets)))
    starts = sorted(at for _, _, at in media.cues)
    seeks = sum(bisect_left(starts, p[6]) > 0 for p in packets)
    mean = float(np.frombuffer(payload, np.uint8).mean()) if payload else 0.0
    return f"tracks={len(media.tracks)};clusters={media.clusters};packets={len(packets)};cues={len(media.cues)};behind_cues={seeks};lacing={kinds};duration={media.duration:.0f};last={packets[-1][3]};mean={mean:.3f};crossings={crossed}"


def figures(data: bytes) -> tuple[int, str, int, int, str, str]:
    """What op5 reports of a stored file: its packet table is made, and the payload joined from the packets' byte ranges."""
    media, packets = packet_rows(data)
    if media is None or packets[0][0] is not None:
        raise ValueError(f"a stored file without packets: {packets[0][0]}")
    back = b"".join([data[p[6] : p[7]] for p in packets])
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, packets, back)


FIGURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The figures of every document's text: all are stored as a table of Matroska files, which is read again and parsed.

    A row for each row, repeated ones too; null texts are empty; other columns are left out.
    """
    own = documents.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    sized = own.withColumn("__bytes", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long"))
    files = stored(with_media(sized, "__text", "__media").drop("__text"), "media", "zstd").select(F.col("__key").alias(key), F.col("__bytes").alias("n_bytes"), "__media")
    schema = files.drop("__media").schema
    for x in FIGURES.split(", "):
        schema.add(*x.split())
    types = [pa.int64() if x.endswith("long") else pa.string() for x in FIGURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [figures(m.as_py()) for m in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=schema.names)

    return files.mapInArrow(run, schema)


def with_media(documents: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """documents with every text stored as a Matroska file in the binary column `into`."""
    small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c != into]
    schema = documents.select(*[f"`{c}`" for c in kept]).schema.add(into, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([mux(payload_of(t)[1]) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*kept, into])

    return documents.select(*[f"`{c}`" for c in kept], F.col(f"`{text}`").cast("string").alias("__source")).mapInArrow(run, schema)
