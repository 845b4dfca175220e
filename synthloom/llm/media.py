"""ISO media containers: raw frames stored in a movie file, and its boxes and sample tables read back without decoding."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.llm.common import slices, table, text_of

#: A frame of 24 x 24 grey samples of 8 bits.
WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
CODEC = b"raw "
TIMESCALE, TICKS = 600, 24
#: Frames in a chunk, and from one keyframe to the next.
CHUNK, KEY_EVERY = 10, 12
PAD = b"\xff"

#: Boxes that hold boxes, with the bytes before the first one (a 4-byte version and flags, and the entry count of dref).
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"dref": 8, b"meta": 4}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    return struct.pack(">I4s", size, kind) + b"".join(body)


def full(kind: bytes, flags: int, *body: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def movie(payload: bytes, chunk: int = CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """A file with one video track, whose samples are the payload's frames, losslessly. The payload is whole frames."""
    frames = len(payload) // FRAME
    if frames * FRAME != len(payload) or not frames:
        raise ValueError("the payload must be a positive number of whole frames")
    duration = frames * TICKS
    whole, rest = divmod(frames, chunk)
    runs = [(1, chunk)] * bool(whole) + [(whole + 1, rest)] * bool(rest)
    n_chunks = whole + bool(rest)
    keys = range(1, frames + 1, key_every)
    entry = box(CODEC, bytes(6), struct.pack(">HHH12xHHIIIH", 1, 0, 0, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8 | 32, -1))

    def head(offset: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, frames, TICKS)),
            full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            full(b"co64", 0, struct.pack(">I", n_chunks), (offset + np.arange(n_chunks, dtype=np.int64) * chunk * FRAME).astype(">u8").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)),
            full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), table),
        )
        track = box(b"trak", full(b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16)), media)
        moov = box(b"moov", full(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, duration, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), track)
        return box(b"ftyp", b"qt  ", bytes(4), b"qt  ") + moov

    # offsets are 64-bit fields, so the head is as long whatever they are
    data = len(head(0)) + 16
    return head(data) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, begin, end) of the body of every box, parents first. Sizes 0 (to the end) and 1 (64-bit) are known; a box that claims more than there is ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS:
            yield from walk(data, body + CONTAINERS[kind], stop, here)
        start = stop


def probed(file: bytes) -> dict | None:
    """Of the first video or sound track: codec, width, height, timescale, duration, offsets and sizes of samples, and which are keyframes.

    Only boxes and tables are read, no sample. None if there is no whole track.
    """
    data = memoryview(file)
    tracks: list[dict] = []
    for path, a, b in walk(data, 0, len(data)):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and path[-1] not in tracks[-1]:
            tracks[-1][path[-1]] = (a, b)
    for t in tracks:
        offsets = t.get(b"stco") or t.get(b"co64")
        if not offsets or not all(k in t for k in (b"mdhd", b"stsd", b"stsc", b"stsz")):
            continue
        a = t[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        entry = t[b"stsd"][0] + 8
        codec = bytes(data[entry + 4 : entry + 8]).decode("latin-1")
        kind = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) if b"hdlr" in t else b""
        width, height = struct.unpack_from(">HH", data, entry + 32) if kind == b"vide" else (0, 0)
        fixed, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, t[b"stsz"][0] + 12).astype(np.int64)
        a, wide = offsets[0], b"stco" not in t
        (n_chunks,) = struct.unpack_from(">I", data, a + 4)
        chunks = np.frombuffer(data, ">u8" if wide else ">u4", n_chunks, a + 8).astype(np.int64)
        a = t[b"stsc"][0]
        (n_runs,) = struct.unpack_from(">I", data, a + 4)
        runs = np.frombuffer(data, ">u4", 3 * n_runs, a + 8).reshape(-1, 3).astype(np.int64)
        in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], n_chunks + 1)))
        chunk = np.repeat(np.arange(n_chunks), in_chunk)[:n]
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, chunk)
        at = chunks[chunk] + before - before[first]
        if b"stss" in t:
            a = t[b"stss"][0]
            (n_keys,) = struct.unpack_from(">I", data, a + 4)
            keys = np.frombuffer(data, ">u4", n_keys, a + 8).astype(np.int64) - 1
        else:  # every sample is one
            keys = np.arange(n)
        return {"codec": codec, "width": width, "height": height, "timescale": timescale, "duration": duration, "offsets": at, "sizes": sizes, "keys": keys}
    return None


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: each text's UTF-8 bytes, padded with 255 to whole frames, as a movie file. Null texts are empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, texts in slices(batch, "_text"):
                files = [movie(x + PAD * (-len(x) % FRAME or FRAME * (not x))) for x in texts]
                yield pa.RecordBatch.from_arrays([run.column(id_col), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], names=schema.names)

    return docs.select(docs[id_col].alias(id_col), text_of(docs[text_col]).cast("binary").alias("_text")).mapInArrow(store, schema)


FEATURES = (
    "codec string, width int, height int, duration_s double, n_samples long, keyframes array<struct<offset:long,length:long>>, "
    "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"
)


def probe_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of `media` with the features of the file in media_col, which is dropped.

    Codec, size, duration and keyframe byte ranges come from boxes and tables; the digests are of the samples' bytes, in
    their order, as the tables place them. Files that are null or hold no whole track have null features. Columns that
    already have a feature's name are replaced.
    """
    new = T.StructType.fromDDL(FEATURES).fields
    names = [f.name for f in new]
    others = [c for c in media.columns if c != media_col and c not in names]
    schema = T.StructType([*(media.schema[c] for c in others), *new])
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, files in slices(batch, media_col):
                rows = [_features(x) for x in files]
                columns = [pa.array([r.get(n) for r in rows], kind) for n, kind in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in others), *columns], names=schema.names)

    return media.select(*others, media_col).mapInArrow(probe, schema)


def _features(file: bytes) -> dict:
    try:
        found = probed(file) if file else None
    except (struct.error, ValueError, IndexError):  # a damaged table
        found = None
    if found is None:
        return {}
    at, sizes = found["offsets"], found["sizes"]
    # samples that lie side by side are read at once
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1] + sizes[:-1])) if len(at) else np.zeros(0, int)
    ends = np.append(new[1:], len(at)) - 1
    payload = b"".join(file[a:b] for a, b in zip(at[new].tolist(), (at[ends] + sizes[ends]).tolist(), strict=True)) if len(at) else b""
    keys = found["keys"]
    return {
        "codec": found["codec"],
        "width": found["width"],
        "height": found["height"],
        "duration_s": found["duration"] / found["timescale"] if found["timescale"] else None,
        "n_samples": len(sizes),
        "keyframes": [{"offset": a, "length": n} for a, n in zip(at[keys].tolist(), sizes[keys].tolist(), strict=True)],
        "media_bytes": len(file),
        "media_sha256": hashlib.sha256(file).hexdigest(),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
    }


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as movie files, and what reading these back tells."""
    found = probe_media(store_media(table(spark, sf_dir, "documents")))
    keys = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["length"].cast("string"))), ",")
    shape = F.format_string("%s %dx%d %.3fs %d samples keyframes ", F.trim("codec"), "width", "height", "duration_s", "n_samples")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(shape, keys).alias("feature"))
