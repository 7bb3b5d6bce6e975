"""Columns of ISO base media files: boxes are walked and sample tables decoded, payloads are not.

``write_track`` makes a file with one audio track of unsigned 8-bit samples; ``read_tracks``
reads any file of nested boxes (64-bit sizes, a last box of size 0, several tracks,
``stsz``/``stz2``, ``stco``/``co64``, ``stss``) and gives each track's codec, duration and
the byte ranges of its samples and key frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import batches

FRAME = 64
RATE = 8000
KEY_EVERY = 16
FRAMES_PER_CHUNK = 32

# Fixed values of the format: boxes that hold boxes, and the identity matrix of headers.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """A file whose boxes or tables contradict each other."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of FRAME."""
    return raw + bytes(max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def _words(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def write_track(payload: bytes) -> bytes:
    """A file of ``payload`` (a positive multiple of FRAME) as mono unsigned 8-bit samples.

    A sample of the track is a frame of FRAME bytes; every KEY_EVERY-th is a sync sample, and
    FRAMES_PER_CHUNK frames make a chunk.
    """
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise MediaError(f"payload of {len(payload)} bytes is no positive multiple of {FRAME}")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat_head = 8 if len(payload) + 8 < 1 << 32 else 16
    chunk_at = len(head) + mdat_head + np.arange(0, len(payload), FRAME * FRAMES_PER_CHUNK, dtype=np.int64)
    wide = bool(chunk_at[-1] >= 1 << 32)
    runs = [(1, min(frames, FRAMES_PER_CHUNK), 1)]
    if len(chunk_at) > 1 and frames % FRAMES_PER_CHUNK:
        runs.append((len(chunk_at), frames % FRAMES_PER_CHUNK, 1))
    duration = len(payload)
    clock = struct.pack(">4I", 0, 0, RATE, duration)
    if duration >= 1 << 32:
        clock = struct.pack(">QQIQ", 0, 0, RATE, duration)
    v = int(duration >= 1 << 32)
    sound = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)
    tables = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), box(b"raw ", sound)),
        full_box(b"stts", _words([1, frames, FRAME])),
        full_box(b"stss", _words([-(-frames // KEY_EVERY)]), _words(np.arange(1, frames + 1, KEY_EVERY))),
        full_box(b"stsc", _words([len(runs)]), _words(runs)),
        full_box(b"stsz", _words([FRAME, frames])),
        full_box(b"co64" if wide else b"stco", _words([len(chunk_at)]), chunk_at.astype(">u8" if wide else ">u4").tobytes()),
    )
    header = full_box(b"mvhd", clock, struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=v)
    track_clock = struct.pack(">QQIIQ", 0, 0, 1, 0, duration) if v else struct.pack(">5I", 0, 0, 1, 0, duration)
    track = box(
        b"trak",
        full_box(b"tkhd", track_clock, struct.pack(">8xHHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=v, flags=7),
        box(
            b"mdia",
            full_box(b"mdhd", clock, struct.pack(">HH", 0x55C4, 0), version=v),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(
                b"minf",
                full_box(b"smhd", bytes(4)),
                box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))),
                tables,
            ),
        ),
    )
    return head + box(b"mdat", payload) + box(b"moov", header, track)


@dataclass
class Track:
    handler: str
    codec: str
    timescale: int
    duration: int
    samples: int
    offsets: np.ndarray
    sizes: np.ndarray
    key_ranges: list[tuple[int, int]]  # [first byte, end) of sync samples, adjoining ones merged

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Every box as (path, first byte of its body, end), parents before children."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise MediaError(f"box {kind!r} at {at} is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body = at + 16
        elif size == 0:
            size = end - at
        if at + size > end or body > at + size:
            raise MediaError(f"box {kind!r} at {at} does not fit its parent")
        yield (*path, kind), body, at + size
        if kind in CONTAINERS:
            yield from walk(data, body, at + size, (*path, kind))
        at += size


def _table(data: memoryview, body: int, end: int, columns: int, skip: int = 4, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + skip)
    width = np.dtype(kind).itemsize
    if body + skip + 4 + n * columns * width > end:
        raise MediaError("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, body + skip + 4).astype(np.int64).reshape(n, columns)


def _track(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> Track:
    def need(kind: bytes) -> tuple[int, int]:
        if kind not in boxes:
            raise MediaError(f"a track has no {kind.decode('latin-1')} box")
        return boxes[kind]

    at, _ = need(b"mdhd")
    timescale, duration = struct.unpack_from(*((">IQ", data, at + 20) if data[at] == 1 else (">II", data, at + 12)))
    codec = bytes(data[(x := need(b"stsd")[0] + 8) + 4 : x + 8]).decode("latin-1")
    handler = bytes(data[need(b"hdlr")[0] + 8 :][:4]).decode("latin-1")
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else _table(data, at, end, 1, skip=8)[:, 0]
    else:
        at, end = need(b"stz2")
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits not in (4, 8, 16) or at + 12 + -(-n * bits // 8) > end:
            raise MediaError("a compact size table is longer than its box")
        if bits == 4:
            pairs = np.frombuffer(data, np.uint8, -(-n // 2), at + 12)
            sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
        else:
            sizes = np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)
    chunks = _table(data, *boxes[b"co64"], 1, kind=">u8")[:, 0] if b"co64" in boxes else _table(data, *need(b"stco"), 1)[:, 0]
    runs = _table(data, *need(b"stsc"), 3)
    per_chunk = np.zeros(len(chunks), np.int64)
    for (first, many, _), after in zip(runs, [*runs[1:, 0], len(chunks) + 1]):
        per_chunk[first - 1 : after - 1] = many
    if per_chunk.sum() != len(sizes):
        raise MediaError(f"chunks hold {per_chunk.sum()} samples, the size table {len(sizes)}")
    chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk_of] + before[:-1] - before[first[chunk_of]] if len(sizes) else np.empty(0, np.int64)
    keys = _table(data, *boxes[b"stss"], 1)[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
    ranges: list[tuple[int, int]] = []
    for a, b in zip(offsets[keys].tolist(), (offsets[keys] + sizes[keys]).tolist()):
        if ranges and ranges[-1][1] == a:
            ranges[-1] = (ranges[-1][0], b)
        else:
            ranges.append((a, b))
    if len(sizes) and int((offsets + sizes).max()) > len(data):
        raise MediaError("samples lie behind the end of the file")
    return Track(handler, codec, timescale, duration, len(sizes), offsets, sizes, ranges)


def read_tracks(media: bytes) -> list[Track]:
    data, tracks = memoryview(media), []
    for path, body, end in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (body, end))
    return [_track(data, t) for t in tracks]


def samples_of(media: bytes, track: Track) -> bytes:
    """The stored bytes of a track, in the order of its samples."""
    offsets, sizes = track.offsets, track.sizes
    if not len(offsets):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], offsets[1:] != offsets[:-1] + sizes[:-1]]))
    last = np.append(starts[1:], len(offsets)) - 1
    return b"".join(media[a:b] for a, b in zip(offsets[starts].tolist(), (offsets[last] + sizes[last]).tolist()))


def feature_of(track: Track) -> str:
    """Codec, duration in seconds, samples, and the key frames: how many ranges, their bytes, a digest of all."""
    ranges = ",".join(f"{a}-{b}" for a, b in track.key_ranges)
    total = sum(b - a for a, b in track.key_ranges)
    first, last = (track.key_ranges[0], track.key_ranges[-1]) if track.key_ranges else ((0, 0), (0, 0))
    return (
        f"codec={track.codec.strip()};seconds={track.seconds:.6f};samples={track.samples};keys={len(track.key_ranges)}"
        f";key_bytes={total};first={first[0]}-{first[1]};last={last[0]}-{last[1]};ranges={hashlib.md5(ranges.encode()).hexdigest()}"
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, codec, seconds, key_ranges``; with ``contents`` also ``media``.

    Each text's UTF-8 (null: empty), padded with zero bytes to a positive multiple of 64, is
    stored as 8-bit samples of a media file, and read back through the file's own tables.
    Empty texts give one frame of zeros.  Ids may be null or repeat; other columns are ignored.
    """

    def run(it):
        for batch in batches(it):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = write_track(pad(raw))
                (track,) = read_tracks(media)
                back = samples_of(media, track)
                row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media)]
                row += [hashlib.sha256(media).hexdigest(), feature_of(track), track.codec, track.seconds]
                row += [[{"start": a, "end": b} for a, b in track.key_ranges], media if contents else None]
                rows.append(row)
            schema = pa.schema(
                [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
                + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string())]
                + [("seconds", pa.float64()), ("key_ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                + [("media", pa.binary())]
            )
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.record_batch([batch.column("id"), *columns], ["doc_id", *schema.names])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,"
        " feature string, codec string, seconds double, key_ranges array<struct<start: long, end: long>>, media binary",
    )
    return found if contents else found.drop("media")
