"""ISO media containers: walking boxes, reading sample tables, and storing bytes as 8-bit samples.

tracks() walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample tables of each track (stts, stss,
stsc, stsz or stz2, stco or co64) and those of fragments (trex, tfhd, trun), and gives codec, time scale, duration, samples
and the byte ranges of key frames; index() is the first video track, else the first. Payload bytes are never decoded,
and are only read by payload().

store() writes bytes as 24 x 24 pixel, 8-bit grey frames, one sample each, in a file of the same kind. The end is filled
with bytes 255 up to a positive multiple of a frame.

Cases. Null media give null columns and error "null"; bytes that are no such file give the error that was met, and what
was read before. Null texts are empty. Very long texts are one file each, held by a task while it is summed up. Equal
bytes give equal columns, repeated rows a row each. An empty table gives no rows. Only the id and text (or media) columns
are read, so others can have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parzelle.llm import common

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
#: Frames from one key frame to the next, and in a chunk.
GROUP = 8
TIMESCALE, TICKS = 24_000, 1000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data) % FRAME) if data else FRAME)


def store(payload: bytes) -> bytes:
    """The payload, whole frames, as an ISO media file."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload isn't whole frames")
    n = len(payload) // FRAME
    chunks = -(-n // GROUP)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    entry = box(b"raw ", struct.pack(">6xHHH4sIIHHIIIH32shh", 1, 0, 0, b"\0" * 4, 0, 0, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, b"\0" * 32, 40, -1))
    runs = struct.pack(">III", 1, GROUP, 1) if n >= GROUP else b""
    if n % GROUP:
        runs += struct.pack(">III", chunks, n % GROUP, 1)

    def moov(first: int) -> bytes:
        offsets = first + FRAME * GROUP * np.arange(chunks, dtype=np.int64)
        wide = first + len(payload) >= 1 << 32
        table = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", chunks), (1 + GROUP * np.arange(chunks)).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs) // 12), runs),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            table,
        )
        long = struct.pack(">QQIQ", 0, 0, TIMESCALE, n * TICKS)
        minf = box(b"minf", full(b"vmhd", b"\0" * 8, flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", long, struct.pack(">HH", 0x55C4, 0), version=1), full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * TICKS), b"\0" * 16, matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=1, flags=3)
        mvhd = full(b"mvhd", long, struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat = box(b"mdat", payload)
    before = len(head) + len(mdat) - len(payload)
    size = len(moov(0))
    if len(made := moov(before + size)) != size:
        made = moov(before + len(made))
    return head + made + mdat


@dataclass
class Index:
    codec: str | None = None
    timescale: int | None = None
    duration: int | None = None
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    error: str | None = None
    kind: str | None = None
    #: Duration of samples in fragments.
    ticks: int = 0

    def key_ranges(self) -> tuple[list[int], list[int]]:
        return self.offsets[self.key].tolist(), self.sizes[self.key].tolist()


def boxes(data: memoryview, start: int, end: int):
    """(kind, first byte of its content, end), one level."""
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("truncated box")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"bad size of {kind.decode('latin-1')}")
        yield kind, start + head, start + size
        start += size


def _table(data: memoryview, at: int, end: int, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if n * width > end - at:
        raise ValueError("truncated table")
    return np.frombuffer(data, dtype=kind, count=n, offset=at).astype(np.int64)


def _u32(data: memoryview, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def _sample_table(data: memoryview, track: dict, found: Index) -> None:
    """Codec, times, sample ranges and key frames of a track's own tables."""
    a, b = track[b"stsd"]
    if _u32(data, a + 4):
        found.codec = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
    if b"hdlr" in track:
        a, b = track[b"hdlr"]
        found.kind = bytes(data[a + 8 : a + 12]).decode("latin-1")
    if b"mdhd" in track:
        a, b = track[b"mdhd"]
        found.timescale, found.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    if b"stsz" in track:
        a, b = track[b"stsz"]
        one, n = struct.unpack_from(">II", data, a + 4)
        if one and n * one > len(data):
            raise ValueError("more samples than bytes")
        sizes = np.full(n, one, dtype=np.int64) if one else _table(data, a + 12, b, ">u4", n)
    else:
        a, b = track[b"stz2"]
        bits, n = data[a + 7], _u32(data, a + 8)
        if bits == 4:
            pairs = _table(data, a + 12, b, "u1", -(-n // 2))
            sizes = np.column_stack([pairs >> 4, pairs & 15]).reshape(-1)[:n]
        else:
            sizes = _table(data, a + 12, b, {8: "u1", 16: ">u2"}[bits], n)
    kind = b"co64" if b"co64" in track else b"stco"
    a, b = track[kind]
    chunks = _table(data, a + 8, b, ">u8" if kind == b"co64" else ">u4", _u32(data, a + 4))
    a, b = track[b"stsc"]
    runs = _table(data, a + 8, b, ">u4", 3 * _u32(data, a + 4)).reshape(-1, 3)
    lengths = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
    if (lengths < 0).any() or len(runs) and runs[0, 0] != 1:
        raise ValueError("bad chunk runs")
    in_chunk = np.repeat(runs[:, 1], lengths)
    if in_chunk.sum() < n:
        raise ValueError("fewer chunks than samples")
    if in_chunk.sum() > n:
        in_chunk = np.diff(np.minimum(np.append(0, np.cumsum(in_chunk)), n))
    first = np.cumsum(in_chunk) - in_chunk
    before = np.cumsum(sizes) - sizes
    chunk_of = np.repeat(np.arange(len(in_chunk)), in_chunk)
    offsets = chunks[chunk_of] + before - before[np.minimum(first, max(n - 1, 0))[chunk_of]] if n else np.zeros(0, np.int64)
    if n and ((offsets < 0) | (offsets + sizes > len(data))).any():
        raise ValueError("samples beyond the file")
    found.offsets, found.sizes = offsets, sizes
    if b"stss" in track:
        a, b = track[b"stss"]
        found.key = _table(data, a + 8, b, ">u4", _u32(data, a + 4)) - 1
        if len(found.key) and (found.key.min() < 0 or found.key.max() >= n):
            found.key = np.zeros(0, np.int64)
            raise ValueError("bad key frames")
    else:
        found.key = np.arange(n)
    if found.duration in (None, 0) and b"stts" in track:
        a, b = track[b"stts"]
        found.duration = int(_table(data, a + 8, b, ">u4", 2 * _u32(data, a + 4)).reshape(-1, 2).prod(axis=1).sum())


def _fragment(data: memoryview, traf: dict, defaults: dict[int, tuple[int, int, int]], base: int, by_id: dict[int, Index]) -> int:
    """The samples of a track's fragment, added to the track; returns where their bytes end."""
    a, _ = traf[b"tfhd"]
    flags, track = _u32(data, a) & 0xFFFFFF, _u32(data, a + 4)
    at = a + 8
    if flags & 1:
        base = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 * bool(flags & 2)
    values = list(defaults.get(track, (0, 0, 0)))
    for i, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            values[i] = _u32(data, at)
            at += 4
    found = by_id.get(track)
    if found is None:
        raise ValueError("a fragment of no track")
    end = base
    for a, b in traf.get(b"trun", ()):
        flags, n = _u32(data, a) & 0xFFFFFF, _u32(data, a + 4)
        at = a + 8
        if flags & 1:
            end = base + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & 4:
            first = _u32(data, at)
            at += 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if not fields and n > len(data):
            raise ValueError("more samples than bytes")
        table = dict(zip(fields, _table(data, at, b, ">u4", n * len(fields)).reshape(n, len(fields)).T, strict=True))
        ticks, sizes, marks = (table.get(bit, np.full(n, value, dtype=np.int64)) for bit, value in zip((0x100, 0x200, 0x400), values, strict=True))
        if first is not None and n and 0x400 not in table:
            marks = np.append(first, marks[1:])
        offsets = end + np.cumsum(sizes) - sizes
        if n and (end < 0 or offsets[-1] + sizes[-1] > len(data)):
            raise ValueError("samples beyond the file")
        found.key = np.append(found.key, len(found.sizes) + np.flatnonzero(marks & 0x10000 == 0))
        found.offsets, found.sizes = np.append(found.offsets, offsets), np.append(found.sizes, sizes)
        found.ticks += int(ticks.sum())
        end = int(end + sizes.sum())
    return end


def tracks(media: bytes) -> tuple[list[Index], str | None]:
    """All tracks with a sample table, in order, and the error that the walk itself met."""
    data = memoryview(media)
    boxed: list[dict] = []
    fragments: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    error = None

    def walk(start: int, end: int, own: dict | None, depth: int, moof: int) -> None:
        if depth > 16:
            raise ValueError("boxes nested too deep")
        begin = start
        for kind, a, b in boxes(data, start, end):
            held = own
            if kind == b"trak":
                held = {}
                boxed.append(held)
            elif kind == b"traf":
                held = {"moof": moof}
                fragments.append(held)
            if kind in NESTED:
                walk(a, b, held, depth + 1, begin if kind == b"moof" else moof)
            elif kind == b"trex" and b - a >= 24:
                track, _, *values = struct.unpack_from(">5I", data, a + 4)
                defaults[track] = tuple(values)
            elif own is not None and kind == b"trun":
                own.setdefault(kind, []).append((a, b))
            elif own is not None:
                own[kind] = a, b
            begin = b

    try:
        walk(0, len(data), None, 0, 0)
    except ValueError as e:
        error = str(e)
    out, by_id = [], {}
    for track in boxed:
        if b"stsd" not in track or not (b"stsz" in track or b"stz2" in track):
            continue
        found = Index()
        out.append(found)
        try:
            if b"tkhd" in track:
                a, _ = track[b"tkhd"]
                by_id[_u32(data, a + (20 if data[a] else 12))] = found
            _sample_table(data, track, found)
        except (ValueError, KeyError, struct.error, IndexError) as e:
            found.error = f"no {e.args[0].decode()}" if isinstance(e, KeyError) and isinstance(e.args[0], bytes) else str(e)
    last, end = None, 0
    for traf in fragments:
        try:
            end = _fragment(data, traf, defaults, traf["moof"] if traf["moof"] != last or _u32(data, traf[b"tfhd"][0]) & 0x20000 else end, by_id)
        except (ValueError, KeyError, struct.error, IndexError) as e:
            error = error or (f"no {e.args[0].decode()}" if isinstance(e, KeyError) and isinstance(e.args[0], bytes) else str(e))
        last = traf["moof"]
    for found in out:
        found.duration = found.ticks if found.ticks and not found.duration else found.duration
    return out, error


def index(media: bytes) -> Index:
    """The first video track, else the first track."""
    found, error = tracks(media)
    best = next((t for t in found if t.kind == "vide"), found[0] if found else Index(error=error or "no sample table"))
    best.error = error or best.error
    return best


def payload(media: bytes, found: Index) -> bytes:
    """The samples, one after the other."""
    ends = found.offsets + found.sizes
    starts = np.flatnonzero(np.append(True, found.offsets[1:] != ends[:-1])) if len(ends) else []
    stops = np.append(starts[1:], len(ends)) if len(ends) else []
    return b"".join(media[found.offsets[i] : ends[j - 1]] for i, j in zip(starts, stops, strict=True))


MEDIA = "track int, kind string, codec string, timescale long, duration long, samples long, key_offsets array<long>, key_sizes array<long>, error string"


def media_columns(df: DataFrame, media_col: str = "media", id_col: str = "id", all_tracks: bool = False) -> DataFrame:
    """id, track (from 1), kind, codec, timescale, duration, samples, key_offsets, key_sizes, error for a binary column: a row for each file, of its main track, or for each track; a file without one is a row with its error."""
    names = [x.split()[0] for x in MEDIA.split(", ")]

    def of(data: bytes | None) -> list[tuple[int | None, Index]]:
        if data is None:
            return [(None, Index(error="null"))]
        found, error = tracks(data)
        numbered = list(enumerate(found, 1))
        for _, track in numbered:
            track.error = error or track.error
        if not numbered:
            return [(None, Index(error=error or "no sample table"))]
        return numbered if all_tracks else [next((x for x in numbered if x[1].kind == "vide"), numbered[0])]

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))

    def run(batches):
        for part in common.slices(batches, "media"):
            out: list[list] = [[] for _ in range(1 + len(names))]
            for doc, data in zip(part.column("id").to_pylist(), part.column("media").to_pylist(), strict=True):
                for number, found in of(data):
                    row = (doc, number, found.kind, found.codec, found.timescale, found.duration, len(found.sizes), *found.key_ranges(), found.error)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            types = [part.schema.field("id").type, *common.arrow_types(MEDIA)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["id", *names])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, {MEDIA}").withColumnRenamed("id", id_col)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text, padded, as a media file."""

    def make():
        def run(texts: pa.Array) -> dict:
            data = common.as_bytes(texts)
            return {"n_bytes": [len(x) for x in data], "media": [store(pad(x)) for x in data]}

        return run

    return common.map_texts(df, id_col, text_col, make, "n_bytes long, media binary")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, walks the stored bytes, reads the payload back through the sample tables and sums all up; media files don't leave the task."""

    def make():
        def run(texts: pa.Array) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in common.as_bytes(texts):
                media = store(pad(text))
                found = index(media)
                if found.error:
                    raise ValueError(found.error)
                back = payload(media, found)
                ranges = ",".join(f"{a}+{b}" for a, b in zip(*found.key_ranges(), strict=True))
                feature = f"codec={found.codec};timescale={found.timescale};duration={found.duration};samples={len(found.sizes)};keyframes={ranges}"
                for k, v in zip(out, (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    out[k].append(v)
            return out

        return run

    return common.map_texts(df, id_col, text_col, make, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
