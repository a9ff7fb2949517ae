"""Removal of long repeated passages with a run-length Burrows-Wheeler index.

Every window of ``LENGTH`` bytes that also starts in a document of a smaller
doc_id goes. Windows are dealt out by content: each belongs to the anchor, the
least-hashed ``GRAM`` bytes inside it, so equal windows have equal anchors at
equal distances wherever they occur, and a run of windows with one anchor is
one segment.

1. Anchors are gathered by hash; those of two or more documents are repeated.
   Chunks of several segments are gathered by a 128-bit digest: where a smaller
   document holds the same chunk, all its windows go and need no more work.
2. Documents cut out the remaining segments of their repeated anchors; equal
   segments are pre-aggregated to their smallest document.
3. Segments of one anchor that differ are indexed: their windows are sorted,
   the preceding bytes form the Burrows-Wheeler column, and only its runs are
   kept, each with the smallest document sampled at its end and the place to
   which it leads one byte to the left. Matching statistics, up to ``LENGTH``,
   stream over the segments from right to left by these steps, and windows are
   marked where the samples hold a smaller document.
   Anchors of very many different segments part into longer ones: a window
   belongs to the anchor with the bytes on that side of which it has more, and
   so on until no anchor is crowded or it is the window itself.
4. Marks go back to the documents, which drop the covered bytes.

Equal segments are told by their bytes; only where marks return to documents
does a 64-bit hash beside that of the anchor stand for a segment, and a
128-bit digest for a chunk.

Defined cases: null text is empty; matches never cross documents, and a window
repeated in one document alone stays; rows that repeat a doc_id are one
document for matching and are each returned; rows without a doc_id come before
all others, by the hash of their text, equal ones as one document; texts
shorter than a window stay whole; a very long text is one row of a block,
blocks being counted by bytes; an empty table gives an empty result; further
columns are ignored, but for those named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .text import whole

LENGTH = 50
GRAM = 24
#: Segments in a chunk, on average.
SEGMENTS_IN_CHUNK = 8
#: The mask of a mark that covers all its windows, and what stands before the first window of a segment.
ALL, NOTHING = -1, 256
#: Bytes of documents that travel together when marks meet texts.
BLOCK_BYTES = 1 << 20
#: Different segments of one anchor from which on it parts into longer ones.
CROWDED = 400
#: Bytes of segments that are indexed at once.
INDEX_BYTES = 4 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, first byte highest."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on."""
    words = _words(data)
    n = len(data) - gram + 1
    hashed = words[:n] * _MIX[0]
    for k, at in enumerate([*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
        hashed = (hashed ^ (hashed >> np.uint64(29)) ^ words[at : at + n]) * _MIX[1 + k % 3]
    return hashed ^ (hashed >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each segment of a text of bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = gram_hashes(data, gram)
    n = len(hashed)
    # Hash above, place below: the least of a range names its leftmost least gram.
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.diff(first, append=len(place)), hashed[place[first]] >> np.uint64(16)


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint8) for t in column]


def chunks(data: np.ndarray, first: np.ndarray, n: np.ndarray, gram: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first segment, digest) of each chunk: segments from one anchor whose hash says so up to the next.

    Equal chunks hold equal windows, so only the smallest document of a chunk need be compared any further.
    """
    import xxhash

    if not len(first):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    opens = gram % np.uint64(SEGMENTS_IN_CHUNK) == 0
    opens[0] = True
    at = np.flatnonzero(opens)
    low = first[at]
    high = np.append(low[1:], first[-1] + n[-1]) + length - 1
    view = memoryview(np.ascontiguousarray(data))
    digests = b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(low.tolist(), high.tolist())])
    return at, np.frombuffer(digests, "<u8").reshape(-1, 2)


def block_of(docs: np.ndarray, blocks: int) -> np.ndarray:
    """What Spark's pmod(hash(d), blocks) gives: 32-bit Murmur3 of a long, seed 42."""
    u32, turn = np.uint32, lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    words = docs.astype("<i8").view("<u4").reshape(-1, 2)
    h = np.full(len(docs), 42, u32)
    for k in range(2):
        h = turn(h ^ (turn(words[:, k] * u32(0xCC9E2D51), 15) * u32(0x1B873593)), 13) * u32(5) + u32(0xE6546B64)
    h ^= u32(8)
    h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
    h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
    return (h ^ (h >> u32(16))).view(np.int32).astype(np.int64) % blocks


def _pack(docs: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Documents, sorted, as differences, and their keys: 6 bytes of a gram or 16 of a chunk."""
    gaps = np.diff(docs, prepend=np.int64(0)).astype("<i8").tobytes()
    width = 6 if keys.shape[1] == 1 else 16
    return zlib.compress(gaps, 1), np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), -1)[:, :width].tobytes()


def _unpack(docs: bytes, keys: bytes, kind: int) -> tuple[np.ndarray, np.ndarray]:
    docs = np.cumsum(np.frombuffer(zlib.decompress(docs), "<i8"))
    if kind == CHUNK:
        return docs, np.frombuffer(keys, "<u8").reshape(-1, 2)
    out = np.zeros((len(docs), 8), np.uint8)
    out[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return docs, out.view("<u8")


def _groups(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents and keys in order of key and document, where keys begin, and where another document of the key does."""
    by = np.lexsort((docs, *keys.T))
    docs, keys = docs[by], keys[by]
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    return docs, keys, new, np.append(True, docs[1:] != docs[:-1]) & ~new


def _told(docs: np.ndarray, keys: np.ndarray, new: np.ndarray, other: np.ndarray, kind: int) -> np.ndarray:
    """Which documents learn of a key: all of two or more that hold a gram, all but the smallest that hold a chunk."""
    group = np.cumsum(new) - 1
    if kind == GRAM_KEY:
        return (np.bincount(group, other) > 0)[group]
    return docs != docs[np.flatnonzero(new)][group]


_DEALT = "bucket long, kind int, docs binary, keys binary"
_DEALT_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_DEALT_NAMES = ["bucket", "kind", "docs", "keys"]
GRAM_KEY, CHUNK = 0, 1


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 2000):
        columns = zip(zip(*rows[lo : lo + 2000]), _DEALT_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], _DEALT_NAMES)


def _rows(docs: np.ndarray, keys: np.ndarray, kind: int, to: np.ndarray, sign: int) -> Iterator[tuple]:
    """Packed rows for each value of ``to``; a negative bucket -1 - block is an answer for the documents of a block."""
    by = np.lexsort((docs, to))
    docs, keys, to = docs[by], keys[by], to[by]
    bounds = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
    for lo, hi in zip(bounds, bounds[1:]):
        yield int(to[lo]) if sign > 0 else -1 - int(to[lo]), kind, *_pack(docs[lo:hi], keys[lo:hi])


def _gathered(buckets: int, blocks: int, length: int):
    """Keys of documents for each bucket; what a batch itself shows to be repeated is answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            ids, found = given.column("d").to_pylist(), {GRAM_KEY: [], CHUNK: []}
            for data in _bytes(given.column("text")):
                first, n, gram = anchors(data, length)
                found[GRAM_KEY].append(gram[:, None])
                found[CHUNK].append(chunks(data, first, n, gram, length)[1])
            for kind, keys in found.items():
                docs = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
                if not len(docs):
                    continue
                docs, keys, new, other = _groups(docs, np.concatenate(keys))
                told = _told(docs, keys, new, other, kind)
                # One document stands for a key, and for a gram a second one proves that it is repeated.
                sent, at = new.copy(), np.flatnonzero(other)
                if kind == GRAM_KEY:
                    sent[at[np.unique((np.cumsum(new) - 1)[at], return_index=True)[1]]] = True
                bucket = ((keys[sent][:, 0] >> np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
                yield from _batches(list(_rows(docs[sent], keys[sent], kind, bucket, 1)))
                yield from _batches(list(_rows(docs[told], keys[told], kind, block_of(docs[told], blocks), -1)))

    return run


def _answered(blocks: int):
    """Answers for blocks of documents; input sorted by bucket."""

    def decide(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for kind in (GRAM_KEY, CHUNK):
            parts = [_unpack(d, k, kind) for own, d, k in held if own == kind]
            if parts:
                docs, keys, new, other = _groups(*map(np.concatenate, zip(*parts)))
                told = _told(docs, keys, new, other, kind)
                yield from _batches(list(_rows(docs[told], keys[told], kind, block_of(docs[told], blocks), -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for given in batches:
            for row in zip(*(given.column(i).to_pylist() for i in range(4))):
                if row[0] < 0:
                    yield from _batches([row])
                    continue
                if row[0] != bucket and held:
                    yield from decide(held)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield from decide(held)

    return run


_SEGMENTS = "block long, d long, h long, first int, n int, gram long, segment binary"


def _by_document(docs: np.ndarray, *values: np.ndarray) -> dict[int, tuple]:
    if not len(docs):
        return {}
    by = np.argsort(docs, kind="stable")
    docs = docs[by]
    bounds = [*np.flatnonzero(np.append(True, docs[1:] != docs[:-1])).tolist(), len(docs)]
    sorted_values = [v[by] for v in values]
    return {int(docs[lo]): tuple(v[lo:hi] for v in sorted_values) for lo, hi in zip(bounds, bounds[1:])}


def _cut(length: int):
    """Segments of the repeated anchors of a block's documents; a chunk that a smaller document holds is one row without bytes."""
    schema = pa.schema([("block", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("gram", pa.int64()), ("segment", pa.binary())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = []
        for kind in (GRAM_KEY, CHUNK):
            rows = zip(*(answers.column(c).to_pylist() for c in ("kind", "docs", "keys")))
            parts = [_unpack(d, k, kind) for own, d, k in rows if own == kind]
            known.append(_by_document(*map(np.concatenate, zip(*parts))) if parts else {})
        grams, lost = known
        out: list[tuple] = []
        for block, d, h, data in zip(*(texts.column(c).to_pylist() for c in ("block", "d", "h", "text"))):
            if d not in grams and d not in lost:
                continue
            data = np.frombuffer(data, np.uint8)
            first, n, gram = anchors(data, length)
            some = np.zeros(len(gram), bool)
            if d in grams:
                held = np.unique(grams[d][0])
                some = held[np.minimum(np.searchsorted(held, gram), len(held) - 1)] == gram
            if d in lost:
                gone = {bytes(k) for k in lost[d][0]}
                at, digests = chunks(data, first, n, gram, length)
                whole_chunks = np.array([bytes(k) in gone for k in digests])
                some &= ~np.repeat(whole_chunks, np.diff(at, append=len(first)))
                low, high = first[at], np.append(first[at[1:]], first[-1] + n[-1])
                k = int(whole_chunks.sum())
                zero = np.zeros(k, np.int64)
                out.append((block, d, h, low[whole_chunks], (high - low)[whole_chunks], zero, zero, data[:0]))
            first, n, gram = first[some], n[some], gram[some]
            size = n + length - 1
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            out.append((block, d, h, first, n, gram.astype(np.int64), size, data[at]))
        if not out:
            return schema.empty_table()
        counts = [len(o[3]) for o in out]
        owner = [np.repeat(np.array([o[k] for o in out], np.int64), counts) for k in range(3)]
        first, n, gram, size, data = (np.concatenate([o[k] for o in out]) for k in range(3, 8))
        ends = np.append(0, np.cumsum(size))
        absent = pa.array(size == 0)
        segment = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        segment = pc.if_else(absent, pa.scalar(None, pa.binary()), segment)
        columns = [*map(pa.array, owner), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(gram), segment]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


class RunIndex:
    """Run-length Burrows-Wheeler column over the windows of segments, with samples at run ends.

    Rows are windows in order of their bytes, then of the byte before them,
    then of their document. Only runs of equal bytes before equal windows are
    kept: the byte, the document at that end, which is its smallest, and the
    group of equal windows that lies one byte to the left of all of the run.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, opens: np.ndarray, docs: np.ndarray, length: int):
        """Windows at ``starts`` of ``data``, in text order; ``opens`` marks the first of each segment."""
        padded = np.append(data, np.zeros(8, np.uint8))
        words = _words(padded)
        before = np.where(opens, NOTHING, padded[np.maximum(starts, 1) - 1].astype(np.int64))
        keys = [words[starts + k] for k in range(0, length - 7, 8)]
        if length % 8:
            keys.append(words[starts + length - length % 8] >> np.uint64(64 - 8 * (length % 8)))
        order = np.lexsort((docs, before, *keys[::-1]))
        same = np.ones(len(order) - 1, bool)
        for key in keys:
            same &= key[order[1:]] == key[order[:-1]]
        new_window = np.append(True, ~same)
        heads = np.flatnonzero(new_window | np.append(True, before[order[1:]] != before[order[:-1]]))
        group = np.cumsum(new_window) - 1
        place = np.empty(len(order), np.int64)
        place[order] = group
        ends = order[heads]
        #: Runs in order, by group and byte before it, and the group to the left of each.
        self.runs = group[heads] * (NOTHING + 1) + before[ends]
        self.left = place[np.maximum(ends, 1) - 1]
        #: The smallest of the documents sampled at the run ends of each group.
        self.least = np.minimum.reduceat(docs[ends], np.flatnonzero(new_window[heads]))
        #: Where the last window of each segment lies; the others are reached by steps.
        self.last = place[np.append(opens[1:], True)]

    def held_before(self, data: np.ndarray, first: np.ndarray, n: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """A mask for each segment: its windows whose statistic reaches the full length in a smaller document.

        All segments are read at once, each from its last window to its first.
        """
        at, mask, live = self.last.copy(), np.zeros(len(first), np.int64), np.arange(len(first))
        for step in range(int(n.max())):
            live = live[n[live] > step]
            nth = n[live] - 1 - step
            mask[live] |= (self.least[at[live]] < docs[live]).astype(np.int64) << nth
            further = live[nth > 0]
            byte = data[first[further] + n[further] - 2 - step].astype(np.int64)
            at[further] = self.left[np.searchsorted(self.runs, at[further] * (NOTHING + 1) + byte)]
        return mask


def _marked(length: int):
    """(gram, sid, d, mask): the windows of a segment that a segment of a smaller document holds."""
    schema = pa.schema([("gram", pa.int64()), ("sid", pa.int64()), ("d", pa.int64()), ("mask", pa.int64())])

    def index(batch: pa.Table) -> pa.RecordBatch:
        gram, sid, docs = (batch.column(c).to_numpy() for c in ("gram", "sid", "d"))
        mask = np.zeros(len(gram), np.int64)
        edge = gram[1:] != gram[:-1]
        several = np.flatnonzero(~(np.append(True, edge) & np.append(edge, True)))
        if several.size:
            segments = [s.as_py() for s in batch.column("segment").take(pa.array(several))]
            data, sizes = np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments])
            n, first = sizes - length + 1, np.cumsum(sizes) - sizes
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = RunIndex(data, np.repeat(first, n) + nth, nth == 0, np.repeat(docs[several], n), length)
            mask[several] = found.held_before(data, first, n, docs[several])
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(sid), pa.array(docs), pa.array(mask)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for given in batches:  # sorted by gram, whose segments stay together
            held.append(given)
            size += given.nbytes
            if size < INDEX_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = int(np.flatnonzero(gram == gram[-1])[0])
            if cut:
                yield index(table.slice(0, cut).combine_chunks())
                table = table.slice(cut)
            held, size = table.to_batches(), table.nbytes
        if held:
            yield index(pa.Table.from_batches(held).combine_chunks())

    return run


def _parted(length: int):
    """The two parts of segments of a crowded anchor, by longer anchors.

    ``left`` and ``right`` are the bytes by which the anchor has grown. Of what
    a window still has beside it, the larger half is on one side; the anchor
    grows there by as much, so equal windows part alike.
    """
    room = length - GRAM
    schema = pa.schema([(c, pa.int64()) for c in ("gram", "sid", "d")] + [("shift", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("part_gram", pa.int64()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for given in batches:
            if not given.num_rows:
                continue
            segments = given.column("segment").to_pylist()
            sizes = np.array([len(s) for s in segments])
            first = np.cumsum(sizes) - sizes
            hashed = gram_hashes(np.frombuffer(b"".join(segments), np.uint8)) >> np.uint64(32)
            places = hashed[first[:, None] + np.arange(room + 1)].argmin(axis=1).tolist()
            columns: list[list] = [[] for _ in schema]
            ids = zip(*(given.column(c).to_pylist() for c in ("gram", "sid", "d", "left", "right")))
            for (gram, sid, d, left, right), segment, at in zip(ids, segments, places):
                grown = -(-(room - left - right) // 2)
                n = len(segment) - length + 1
                # Windows from here on have room for it on the right, those before on the left.
                border = min(max(at - (room - right - grown), 0), n)
                for low, high, more_left, more_right in ((0, border, grown, 0), (border, n, 0, grown)):
                    if low < high:
                        x, y = left + more_left, right + more_right
                        core = segment[at - x : at + GRAM + y]
                        row = (gram, sid, d, low, x, y, xxhash.xxh64_intdigest(core, 1 + (more_left > 0)) >> 1, segment[low : high + length - 1])
                        for column, value in zip(columns, row):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _marks_of(segments: DataFrame, length: int, scratch: Scratch, left_over: int) -> DataFrame:
    """(gram, sid, d, mask) of the distinct ``segments``; ``left_over`` is by how much anchors may still grow."""
    crowded = None
    if left_over:
        crowded = scratch.write(segments.groupBy("gram").count().where(F.col("count") > CROWDED).select("gram"), "crowded")
        crowded = None if crowded.isEmpty() else crowded
    rest = segments.join(crowded, "gram", "left_anti") if crowded is not None else segments
    marks = (
        rest.select("gram", "sid", "d", "segment")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_marked(length), "gram long, sid long, d long, mask long")
    )
    if crowded is None:
        return marks
    parts = segments.join(crowded, "gram", "left_semi").select("gram", "sid", "d", "left", "right", "segment")
    parts = parts.mapInArrow(_parted(length), "gram long, sid long, d long, shift int, left int, right int, part_gram long, part binary")
    parts = scratch.write(parts.withColumn("part_sid", F.xxhash64("part")), "parts", compression="zstd")
    distinct = parts.groupBy(F.col("part_gram").alias("gram"), F.col("part_sid").alias("sid"), "left", "right", F.col("part").alias("segment"))
    distinct = scratch.write(distinct.agg(F.min("d").alias("d")), "distinct", compression="zstd")
    # Written first, so that both sides of the join come from a shuffle and a hot part can be split.
    found = scratch.write(_marks_of(distinct, length, scratch, left_over // 2), "part-marks").select(F.col("gram").alias("part_gram"), F.col("sid").alias("part_sid"), F.col("d").alias("least"), "mask")
    every = F.expr(f"shiftleft(1L, octet_length(part) - {length - 1}) - 1")
    mask = F.when(F.col("d") > F.col("least"), every).otherwise(F.col("mask"))
    whole_masks = parts.join(found, ["part_gram", "part_sid"]).select("gram", "sid", "d", "shift", mask.alias("mask"))
    whole_masks = whole_masks.groupBy("gram", "sid", "d").agg(F.bit_or(F.expr("shiftleft(mask, shift)")).alias("mask"))
    return marks.unionByName(whole_masks)


def _removed(length: int, whole_characters: bool):
    """Drop the bytes that marked windows cover; ``rest`` is passed through."""
    counts = ["n_bytes", "n_removed", "n_spans"]

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        docs, hashes, first, n, mask = (marks.column(c).to_numpy() for c in ("d", "h", "first", "n", "mask"))
        found = _by_document(docs, hashes, first, n, mask)
        rows = []
        for d, h, data in zip(*(texts.column(c).to_pylist() for c in ("d", "h", "text"))):
            size, removed, spans = len(data), 0, 0
            if d in found:
                own, first, n, mask = (v[found[d][0] == h] for v in found[d])
                cover = np.zeros(size + 1, np.int32)
                every = mask == ALL
                np.add.at(cover, first[every], 1)
                np.add.at(cover, (first + n)[every] + length - 1, -1)
                some, bit = ~every, np.arange(length)
                starts = (first[some, None] + bit)[(mask[some, None] >> bit) & 1 == 1]
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed, spans = int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum())
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                if whole_characters:
                    data = data.decode(errors="ignore").encode()
            rows.append((size, removed, spans, data))
        columns = list(zip(*rows)) or [[]] * 4
        arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.binary())]
        return pa.Table.from_arrays([texts.column("rest"), *arrays], ["rest", *counts, "kept"])

    return run


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of steps whose results are written go when the driver's references do."""
    spark._jvm.System.gc()


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``; kept is the bytes that are left.

    ``keep`` names further columns to pass through. A removed run may start or
    end inside a character; ``whole_characters`` drops what is left of it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    rest = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *keep).alias("rest")
    rows = docs.select(rest, whole(F.col("text")).alias("text"))
    blocks = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(
        "rest",
        F.coalesce("rest.doc_id", F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("text"), 3)).alias("d"),
        F.xxhash64("text").alias("h"),
        F.encode("text", "UTF-8").alias("text"),
    ).withColumn("block", F.pmod(F.hash("d"), F.lit(blocks)).cast("long"))

    gathered = rows.select("d", "text").mapInArrow(_gathered(buckets, blocks, length), _DEALT)
    answers = gathered.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answered(blocks), _DEALT)
    answers = scratch.write(answers.select((-1 - F.col("bucket")).alias("block"), "kind", "docs", "keys"), "answers")
    _let_go(spark)

    segments = (
        rows.select("block", "d", "h", "text")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_cut(length), _SEGMENTS)
    )
    segments = scratch.write(segments, "segments", compression="zstd")
    scratch.drop(answers)
    _let_go(spark)

    sid = F.xxhash64("segment")
    compared = segments.where("segment is not null")
    distinct = compared.groupBy("gram", "segment").agg(F.min("d").alias("d")).select("*", sid.alias("sid"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    distinct = scratch.write(distinct, "distinct", compression="zstd")
    _let_go(spark)
    marked = scratch.write(_marks_of(distinct, length, scratch, length - GRAM).withColumnRenamed("d", "least"), "marked")
    scratch.drop(distinct)
    _let_go(spark)

    place = ["block", "d", "h", "first", "n"]
    gone = F.when(F.col("d") > F.col("least"), F.lit(ALL)).otherwise(F.col("mask"))
    marks = (
        compared.select(*place, "gram", sid.alias("sid"))
        .join(marked, ["gram", "sid"])
        .select(*place, gone.alias("mask"))
        .where("mask <> 0")
        .unionByName(segments.where("segment is null").select(*place, F.lit(ALL).alias("mask")))
    )
    marks = scratch.write(marks, "marks")
    scratch.drop(segments, marked)
    _let_go(spark)
    kept = T.StructType(
        [
            rows.schema["rest"],
            *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    left = rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_removed(length, whole_characters), kept)
    return left.select("rest.*", "n_bytes", "n_removed", "n_spans", "kept")
