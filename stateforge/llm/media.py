"""Media columns: ISO base media containers (MP4 family).

`mux` stores bytes as the samples of one raw track; `probe` walks the nested
boxes of any such file, decodes the sample tables (stsd, mdhd, stts, stss,
stsc, stsz, stco/co64) and gives codec, duration and the byte range of every
sample and keyframe - without touching a payload.  `payload` reads the stored
samples back by those ranges.

Payload rules of `packed`: a text's UTF-8 bytes (null: none), blanks appended up
to a positive multiple of 192; a sample is 192 bytes, every 16th and the first
is a sync sample (keyframe), a chunk holds 64 samples.  The file has no time
stamps, so equal texts give equal files.  Files of more than 4 GiB get 64-bit
box sizes and chunk offsets.

Defined results: null and empty texts give one sample of blanks; repeated rows
give equal rows; columns beside id and text are ignored.  `probe_column` gives
null fields and the reason in `error` for a null or broken file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, KEY_EVERY, CHUNK_SAMPLES, TIMESCALE, CODEC = 192, 16, 64, 8000, b"raw "
#: Most boxes around a box (the format's own need 6), and boxes that hold boxes.
DEEPEST = 32
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


class Broken(ValueError):
    """A file that its boxes do not describe."""


@dataclass
class Track:
    """What the sample tables of one track say; `durations` has the ticks of every sample."""

    codec: str
    timescale: int
    duration: int
    sizes: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    durations: np.ndarray

    def key_times(self) -> np.ndarray:
        """When every keyframe is decoded, in ticks."""
        return (np.cumsum(self.durations) - self.durations)[self.keys]

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> np.ndarray:
        """(start, end) byte range of every keyframe."""
        return np.stack([self.offsets[self.keys], self.offsets[self.keys] + self.sizes[self.keys]], 1)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(data: bytes) -> bytes:
    """A file whose one track's samples are `data` (a positive multiple of SAMPLE bytes)."""
    n = len(data) // SAMPLE
    wide = len(data) >= (1 << 32) - 4096
    ticks = n * SAMPLE
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(CODEC, struct.pack(">6xHIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    chunks = -(-n // CHUNK_SAMPLES)
    rest = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES)] if rest == CHUNK_SAMPLES else [(1, CHUNK_SAMPLES)] * (chunks > 1) + [(chunks, rest)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1),
            box(b"trak", full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7), media),
        )

    start = len(head) + len(moov(0)) + (16 if len(data) + 8 >= 1 << 32 else 8)
    return head + moov(start) + box(b"mdat", data)


def boxes(file: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes in a range."""
    while start < stop:
        if stop - start < 8:
            raise Broken("cut off inside a box header")
        size, kind = struct.unpack_from(">I4s", file, start)
        body = start + 8
        if size == 1:
            if stop - start < 16:
                raise Broken("cut off inside a box header")
            size, body = struct.unpack_from(">Q", file, body)[0], body + 8
        elif size == 0:
            size = stop - start
        if size < body - start or start + size > stop:
            raise Broken(f"box {kind!r} is longer than what holds it")
        yield kind, body, start + size
        start += size


def walk(file: memoryview, start: int, stop: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes below a range, parents first; boxes nested more than DEEPEST times are an error."""
    open_boxes = [(path, boxes(file, start, stop))]
    while open_boxes:
        path, inside = open_boxes[-1]
        kind, a, b = next(inside, (None, 0, 0))
        if kind is None:
            open_boxes.pop()
            continue
        yield (*path, kind), a, b
        if kind in NESTED:
            if len(open_boxes) == DEEPEST:
                raise Broken(f"boxes are nested more than {DEEPEST} times")
            open_boxes.append(((*path, kind), boxes(file, a, b)))


def probe(file: bytes) -> list[Track]:
    """The tracks of a file, from its tables alone."""
    view = memoryview(file)
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(view, 0, len(view)):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (a, b))
    try:
        return [_track(view, t) for t in tracks]
    except (KeyError, struct.error, ValueError, IndexError) as e:
        raise Broken(f"sample tables: {e}") from e


def _numbers(view: memoryview, at: int, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(view, kind, count, at).astype(np.int64)


def _track(view: memoryview, tables: dict[bytes, tuple[int, int]]) -> Track:
    at, _ = tables[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
    at, end = tables[b"stsd"]
    codec = next((kind for kind, _, _ in boxes(view, at + 8, end)), b"").decode("latin-1")
    at, _ = tables[b"stsz"]
    same, n = struct.unpack_from(">II", view, at + 4)
    if same * n > len(view):
        raise Broken("samples are longer than the file")
    sizes = np.full(n, same, np.int64) if same else _numbers(view, at + 12, n, ">u4")
    wide = b"co64" in tables
    at, _ = tables[b"co64" if wide else b"stco"]
    (count,) = struct.unpack_from(">I", view, at + 4)
    chunks = _numbers(view, at + 8, count, ">u8" if wide else ">u4")
    at, _ = tables[b"stsc"]
    (count,) = struct.unpack_from(">I", view, at + 4)
    runs = _numbers(view, at + 8, 3 * count, ">u4").reshape(-1, 3)
    spread = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (spread < 0).any() or spread.sum() != len(chunks):
        raise Broken("chunks and their runs disagree")
    per_chunk = np.repeat(runs[:, 1], spread)
    if per_chunk.sum() != n:
        raise Broken("chunks and sizes disagree on the number of samples")
    first = np.append(0, np.cumsum(per_chunk))[:-1]
    before = np.append(0, np.cumsum(sizes))[:-1]
    offsets = np.repeat(chunks, per_chunk) + before - np.repeat(before[first] if n else first, per_chunk)
    at, _ = tables[b"stts"]
    (count,) = struct.unpack_from(">I", view, at + 4)
    steps = _numbers(view, at + 8, 2 * count, ">u4").reshape(-1, 2)
    if steps[:, 0].sum() != n:
        raise Broken("times and sizes disagree on the number of samples")
    durations = np.repeat(steps[:, 1], steps[:, 0])
    if durations.sum() > duration:
        raise Broken("the samples last longer than their track")
    if b"stss" in tables:
        at, _ = tables[b"stss"]
        (count,) = struct.unpack_from(">I", view, at + 4)
        keys = _numbers(view, at + 8, count, ">u4") - 1
        if len(keys) and not 0 <= keys.min() <= keys.max() < n:
            raise Broken("a keyframe is no sample")
    else:
        keys = np.arange(n)
    return Track(codec, int(scale), int(duration), sizes, offsets, keys, durations)


def payload(file: bytes, track: Track) -> bytes:
    """The stored samples, read by their ranges; neighbouring samples are read together."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts = track.offsets[np.append(0, cut)]
    stops = ends[np.append(cut - 1, len(ends) - 1)]
    if stops.max() > len(file):
        raise Broken("a sample lies beyond the end")
    return b"".join(file[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def packed(text: str | None) -> bytes:
    """The payload of a text."""
    data = (text or "").encode()
    return data + b" " * (max(SAMPLE, -(-len(data) // SAMPLE) * SAMPLE) - len(data))


def feature(track: Track) -> str:
    """Codec, duration in ticks and scale, samples, keyframes, and a digest of the keyframes' byte ranges."""
    ranges = track.key_ranges().astype("<i8")
    return f"{track.codec.strip()};{track.duration}/{track.timescale};samples={len(track.sizes)};keys={len(ranges)};first={ranges[0][0]}-{ranges[0][1]};ranges={hashlib.sha256(ranges.tobytes()).hexdigest()[:16]}"


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def ranged(track: Track) -> list[dict[str, int]]:
    """The keyframes' byte ranges as rows."""
    return [{"start": a, "end": b} for a, b in track.key_ranges().tolist()]


def stored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_files: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec, seconds, keyframes[, media]) of every row; `keyframes` has their byte ranges."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<start:long,end:long>>" + ", media binary" * with_files
    names = [x.split()[0] for x in fields.split(", ")]

    def one(text: str | None) -> tuple:
        file = mux(packed(text))
        track = probe(file)[0]
        back = payload(file, track)
        row = (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(track), track.codec, track.seconds, ranged(track))
        return (*row, file) if with_files else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), RANGES, pa.binary()]
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # files are as long as texts: few at a time
                part = batch.slice(a, 512)
                cols = list(zip(*(one(x.as_py()) for x in part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types[: len(names)], strict=True))], ["_id", *names])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {fields}").withColumnRenamed("_id", id_col)


PROBED = "codec string, seconds double, samples long, keyframes array<struct<start: long, end: long>>, error string"


def probe_column(files: DataFrame, *, id_col: str, media_col: str) -> DataFrame:
    """(id, codec, seconds, samples, keyframes, error) of the first track of each stored file."""
    kind = files.schema[id_col].dataType.simpleString()
    def one(file: bytes | None) -> tuple:
        try:
            tracks = probe(file) if file else []
            if not tracks:
                return None, None, None, None, "no file" if not file else "no track"
            t = tracks[0]
            return t.codec, t.seconds, len(t.sizes), ranged(t), None
        except (Broken, IndexError, MemoryError, OverflowError) as e:
            return None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.float64(), pa.int64(), RANGES, pa.string()]
        for batch in batches:
            cols = list(zip(*(one(x.as_py()) for x in batch.column(1)), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["_id", "codec", "seconds", "samples", "keyframes", "error"])

    return files.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media")).mapInArrow(run, f"_id {kind}, {PROBED}").withColumnRenamed("_id", id_col)
