"""Binary media columns: lossless 8-bit PNG and a perceptual hash.

A payload is laid out as rows of grey samples and written as a PNG whose
chunks carry their checksums. Reading tests every checksum, inflates and
undoes the row filters in numpy. The hash is the sign pattern of the low
frequencies of a cosine transform of the picture shrunk to 32 x 32.

Defined cases: a null text is the empty text; the payload is the UTF-8 text,
padded with bytes 255 to a positive multiple of the row width, so an empty
text is one row of 255; equal texts give equal values; a null or repeated
doc_id is passed through, one result per row; a very long text is one picture,
whose rows are filtered some at a time; an empty table gives an empty result;
further columns are ignored, whatever their names. Damaged media raise
ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import whole

#: Samples in a row, also the unit of padding.
WIDTH = 576
#: Bytes of media that one output batch may hold before it is sent on.
BATCH_BYTES = 16 << 20
#: Rows of a picture that are filtered at once.
ROWS_AT_ONCE = 2048
#: Fixed value: the eight bytes that open a PNG.
SIGNATURE = b"\x89PNG\r\n\x1a\n"

SIDE, LOW = 32, 8
_k, _n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
COSINES = np.cos(np.pi * (2 * _n + 1) * _k / (2 * SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """Grey 8-bit PNG of ``payload``, whose length is a positive multiple of ``width``.

    Each row takes the filter among none, left and up with the least sum of
    absolute differences.
    """
    every = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = np.empty((len(every), width + 1), np.uint8)
    for low in range(0, len(every), ROWS_AT_ONCE):
        rows = every[low : low + ROWS_AT_ONCE]
        left, up = rows.copy(), rows.copy()
        left[:, 1:] -= rows[:, :-1]
        up[1:] -= rows[:-1]
        if low:
            up[0] -= every[low - 1]
        tried = np.stack([rows, left, up])
        kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
        out[low : low + len(rows), 0] = kind
        out[low : low + len(rows), 1:] = tried[kind, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(every), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes())) + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if len(body) != size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r} fails")
        yield kind, body
        at += 12 + size


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of one-byte samples; runs of equal filters go together."""
    rows, height = rows.copy(), len(rows)
    rows[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
    bounds = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), height]
    for lo, hi in zip(bounds, bounds[1:]):
        kind = kinds[lo]
        if kind == 2:
            if lo:
                rows[lo] += rows[lo - 1]
            rows[lo:hi] = np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8)
        elif kind > 4:
            raise ValueError(f"unknown filter {kind}")
        elif kind > 2:
            for y in range(lo, hi):
                above = rows[y - 1].tolist() if y else [0] * rows.shape[1]
                line, a, c = rows[y].tolist(), 0, 0
                for x, b in enumerate(above):
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                    a, c = (line[x] + guess) & 255, b
                    line[x] = a
                rows[y] = line
    return rows


def decode_png(png: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG without interlacing, as a height x width array."""
    size, packed, ended = None, [], False
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only grey 8-bit pictures without interlacing are read")
            size = height, width + 1
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if size is None or not ended:
        raise ValueError("a chunk is missing")
    data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if data.size != size[0] * size[1]:
        raise ValueError("the picture has another size than it says")
    data = data.reshape(size)
    return _unfiltered(data[:, 0], data[:, 1:])


def cosine_hash(picture: np.ndarray) -> str:
    """16 hex digits: which low cosine frequencies of the shrunk picture lie over their median."""
    small = picture.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        lo = np.arange(SIDE) * n // SIDE
        hi = np.maximum(lo + 1, (np.arange(SIDE) + 1) * n // SIDE)
        sums = np.concatenate([np.zeros_like(small.take([0], axis)), np.cumsum(small, axis)], axis)
        count = (hi - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        small = (sums.take(hi, axis) - sums.take(lo, axis)) / count
    low = (COSINES @ small @ COSINES.T).ravel().round(6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )

    for given in batches:
        rows, held = [], 0
        for doc_id, text in zip(given.column(0).to_pylist(), given.column(1)):
            data = text.as_py().encode()
            payload = data + b"\xff" * (-len(data) % WIDTH or (WIDTH if not data else 0))
            rows.append((doc_id, len(data), encode_png(payload)))
            held += len(rows[-1][2])
            if held > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*(given.column(i).to_pylist() for i in range(3))):
            picture = decode_png(media)
            payload = picture.tobytes()
            rows.append(
                {
                    "doc_id": doc_id,
                    "n_bytes": n_bytes,
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": cosine_hash(picture),
                }
            )
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=FEATURES)


FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG in a binary column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the stored bytes of (doc_id, n_bytes, media) back and describe them."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _featured,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )
