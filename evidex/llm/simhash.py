"""Near-duplicate detection by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within 2r bits of each other have a common variant within r
bits of both. Every distinct fingerprint emits all its variants within half
the radius; whatever meets at one variant is linked, as it is within r of the
same point, so a star at each variant joins what all pairs would join.

A variant travels as the fingerprint and the first ``PREFIX_BITS`` bits of
the variant: 1 + k + k(k-1)/2 rows of two numbers for each fingerprint
instead of 2 081, and the rest of the bits is flipped after the shuffle, in
tasks that hold all fingerprints near their prefixes. Each task joins what
meets and emits at most one link a fingerprint and batch of prefixes, every
one checked again by its distance. Links then contract by alternating large
and small stars over tables in the shared folder.

For a similarity far below what four bits of 64 find, ``near_pairs`` takes wide
fingerprints of ``WORDS`` such words: their bands meet by the same balls, and
the whole fingerprints decide.

Defined cases: a null or empty text has the fingerprint zero and is linked
like any other; rows of one fingerprint are one node, however many there are;
a null doc_id is passed through and never is the smallest unless all are null;
rows that repeat a doc_id are returned as often; a very long text is hashed by
itself, its words and hashes being what a worker holds; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import WHITE_SPACE, whole

SHINGLE = 4
RADIUS = 4
#: Bits of a prefix at least and at most, and fingerprints, as a power of two, that share one on average beyond.
PREFIX_BITS, MOST_PREFIX_BITS, PREFIX_SHARE = 16, 28, 4
SEED = 42
#: Shingles whose bits are unpacked at once, and variants that are held at once.
SHINGLES_AT_ONCE, VARIANTS_AT_ONCE = 1 << 16, 1 << 21
#: Words of 64 bits of a wide fingerprint, its bands, and the bits of a band.
WORDS, BANDS, BAND_BITS = 5, 16, 20
#: Bits of the parts of a band: two bands that differ in two bits agree in one of three parts.
PARTS_OF_BAND = (0x7F << 13, 0x7F << 6, 0x3F)
#: Variants of bands that are held, and pairs that are compared, at once.
BANDED_AT_ONCE, COMPARED_AT_ONCE = 1 << 18, 1 << 14
#: Names of the columns of a wide fingerprint.
WORD_COLUMNS = [f"word{k}" for k in range(WORDS)]

_WORDS = re.compile(f"[^{re.escape(WHITE_SPACE)}]+".encode())
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``size`` words, repeats included; of the whole if there are fewer."""
    import xxhash

    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: -size])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive groups of ``hashes``; a group of none gives zero."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    sums = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = owner[lo : lo + SHINGLES_AT_ONCE]
        bits = np.unpackbits(hashes[lo : lo + SHINGLES_AT_ONCE].astype(">u8").view(np.uint8)).reshape(-1, 64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sums[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    if len(ends):
        out = ((2 * sums > counts[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for the first word, others of the same shingles for each further one."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``WORDS`` words of majority bits for each set of shingle hashes; the empty set gives zeros."""
    counts = np.array([len(s) for s in sets], np.int64)
    flat, ends = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum(counts)
    sums, weights = np.zeros((len(sets), 64), np.int64), np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    # Runs of up to 255 shingles of one set: their bits add up in bytes, eight at once.
    runs = -(-counts // 255)
    owner = np.repeat(np.arange(len(sets)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = (ends - counts)[owner] + 255 * nth
    out = np.zeros((len(sets), WORDS), np.uint64)
    at_once = SHINGLES_AT_ONCE // 255
    for word in range(WORDS):
        sums[:] = 0
        for lo in range(0, len(starts), at_once):
            first, last = starts[lo], starts[lo + at_once] if lo + at_once < len(starts) else len(flat)
            bits = np.unpackbits(_remixed(flat[first:last], word).astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
            some = np.add.reduceat(bits, starts[lo : lo + at_once] - first, axis=0).view(np.uint8)
            mine = owner[lo : lo + at_once]
            heads = np.flatnonzero(np.diff(mine, prepend=-1))
            sums[mine[heads]] += np.add.reduceat(some, heads, axis=0, dtype=np.int64)
        out[:, word] = ((2 * sums > counts[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def bands_of(prints: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` numbers of ``BAND_BITS`` bits for each wide fingerprint; together they are all its bits."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8), axis=1).reshape(len(prints), BANDS, BAND_BITS)
    return (bits * (1 << np.arange(BAND_BITS - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def _fingerprinted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            ids, texts, done = given.column(0), given.column(1), 0
            while done < given.num_rows:  # as many texts as shingles may be held, and one long text by itself
                groups, counts, held, first = [], [], 0, done
                while done < given.num_rows and (not held or held < SHINGLES_AT_ONCE):
                    hashes = shingle_hashes(texts[done].as_buffer().to_pybytes(), size)
                    groups.append(np.array(hashes, np.uint64))
                    counts.append(len(hashes))
                    held, done = held + len(hashes), done + 1
                prints = fingerprints(np.concatenate(groups), np.array(counts, np.int64)).view(np.int64)
                part = ids.slice(first, done - first)
                yield pa.RecordBatch.from_arrays([part, pa.array(prints)], ["doc_id", "fingerprint"])

    return run


def simhash(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint): 64 bits of each row of ``docs`` as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(_fingerprinted(size), "doc_id long, fingerprint long")


def flips(bits: range, most: int) -> np.ndarray:
    """All numbers of at most ``most`` bits set, out of ``bits``."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _met(prefix: np.ndarray, prints: np.ndarray, half: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of the same prefix rows, as (smaller root, fingerprint)."""
    low_bits = 64 - k
    away = np.bitwise_count((prints >> np.uint64(low_bits)) ^ prefix)
    low = prints & np.uint64((1 << low_bits) - 1)
    distinct, node = np.unique(prints, return_inverse=True)
    heads, slot = np.unique(prefix, return_inverse=True)
    left, right = [], []
    masks = {d: flips(range(low_bits), half - d) for d in range(half + 1)}
    # Several prefixes at once, as many as variants may be held; a crowded one goes by ranges of its low bits.
    order = np.argsort(slot, kind="stable")
    sizes = np.array([len(masks[d]) for d in range(half + 1)])[away[order]]
    ends = np.cumsum(sizes)
    bounds = np.flatnonzero(np.diff(slot[order], append=-1)) + 1
    at = 0
    while at < len(order):
        reach = (ends[at - 1] if at else 0) + VARIANTS_AT_ONCE
        fit = bounds[(bounds > at) & (ends[bounds - 1] <= reach)]
        stop = int(fit[-1]) if fit.size else int(bounds[bounds > at][0])
        total = int(ends[stop - 1] - (ends[at - 1] if at else 0))
        part = order[at:stop]
        shards = -(-total // VARIANTS_AT_ONCE)
        for shard in range(shards):
            keys, owners = [], []
            for d in range(half + 1):
                rows = part[away[part] == d]
                for lo in range(0, len(rows), step := max(1, VARIANTS_AT_ONCE // len(masks[d]))):
                    some = rows[lo : lo + step]
                    variants = (low[some][:, None] ^ masks[d]) | (prefix[some] << np.uint64(low_bits))[:, None]
                    owner = np.repeat(some, len(masks[d]))
                    variants = variants.ravel()
                    if shards > 1:
                        mine = (variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                        mine = mine % np.uint64(shards) == shard
                        variants, owner = variants[mine], owner[mine]
                    keys.append(variants)
                    owners.append(owner)
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            by = np.argsort(keys)
            keys, owners = keys[by], owners[by]
            same = np.flatnonzero(keys[1:] == keys[:-1])
            left.append(node[owners[same]])
            right.append(node[owners[same + 1]])
        at = stop
    left, right = np.concatenate(left), np.concatenate(right)
    apart = np.bitwise_count(distinct[left] ^ distinct[right]) > 2 * half
    if apart.any():
        raise ValueError("fingerprints that met are too far apart")
    root = _roots(len(distinct), left, right)
    linked = np.flatnonzero(root != np.arange(len(distinct)))
    return distinct[root[linked]], distinct[linked]


def prefix_bits_for(fingerprints: int) -> int:
    """More bits for more fingerprints, so that what one prefix gathers stays about the same up to 2**32 of them."""
    return min(MOST_PREFIX_BITS, max(PREFIX_BITS, int(fingerprints).bit_length() - PREFIX_SHARE))


def near_links(prints: DataFrame, radius: int = RADIUS, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(a, b): links that join just what all pairs within ``radius`` would join.

    ``prints`` holds distinct values of ``fingerprint``.
    """
    half, k = radius // 2, prefix_bits
    if radius != 2 * half:
        raise ValueError("the radius must be even")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(prefix: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            a, b = _met(prefix.astype(np.uint64), prints.view(np.uint64), half, k)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held_prefix, held_prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for given in batches:  # sorted by prefix, whose last one may go on in the next batch
            held_prefix = np.concatenate([held_prefix, given.column(0).to_numpy(zero_copy_only=False)])
            held_prints = np.concatenate([held_prints, given.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(held_prefix, held_prefix[-1])) if len(held_prefix) else 0
            if cut >= 50_000:
                yield links(held_prefix[:cut], held_prints[:cut])
                held_prefix, held_prints = held_prefix[cut:], held_prints[cut:]
        if len(held_prefix):
            yield links(held_prefix, held_prints)

    near = F.array(*(F.lit(int(m)) for m in flips(range(k), half)))
    top = F.shiftrightunsigned(F.col("fingerprint"), 64 - k)
    dealt = prints.select(
        F.explode(F.transform(near, lambda m: top.bitwiseXOR(m))).alias("prefix"), "fingerprint"
    )
    return (
        dealt.repartition("prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(met, "a long, b long")
    )


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the wide fingerprints in the rows of ``a`` and ``b``."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it counts the magnitude's


def _within(group: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, differing bits) within ``most``, of rows in order of what is to come first, from their groups' ``_banded`` keys.

    At each variant the first row that nothing has been near meets all others there,
    until none is left: what is near another there is near one of the pairs given.
    """
    part, value = (group >> 40) & 3, group & ((1 << BAND_BITS) - 1)
    # What parts a variant from others: its group, numbered from zero, and its bits.
    base = np.unique(group >> BAND_BITS, return_inverse=True)[1].astype(np.int64) << BAND_BITS | value
    rows = [np.flatnonzero(part == k) for k in range(len(PARTS_OF_BAND))]
    masks = [[0, *(1 << b for b in range(BAND_BITS) if not equal >> b & 1)] for equal in PARTS_OF_BAND]
    shards = -(-sum(len(r) * len(m) for r, m in zip(rows, masks)) // BANDED_AT_ONCE)
    found = [np.zeros((3, 0), np.int64)]
    for shard in range(shards):
        keys, owners = [], []
        for mine, flipped in zip(rows, masks):
            for mask in flipped:
                variants = base[mine] ^ mask
                held = (variants.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shards) == shard
                keys.append(variants[held])
                owners.append(mine[held])
        found += _near_first(np.concatenate(keys), np.concatenate(owners), prints, most)
    return tuple(np.concatenate(found, axis=1))


def _near_first(keys: np.ndarray, owner: np.ndarray, prints: np.ndarray, most: int) -> list[np.ndarray]:
    """The pairs (row, row, differing bits) of ``_within`` at the variants ``keys`` of the rows ``owner``."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    head = np.diff(keys, prepend=-1) != 0
    bucket = np.cumsum(head) - 1
    stays = (np.bincount(bucket) > 1)[bucket]
    owner, bucket, found = owner[stays], bucket[stays], []
    free = np.ones(len(owner), bool)
    while len(owner):
        bucket = np.cumsum(np.diff(bucket, prepend=-1) != 0) - 1
        at = np.flatnonzero(free)
        lead = owner[at[np.diff(bucket[at], prepend=-1) != 0]][bucket]
        near = np.zeros(len(owner), bool)
        for lo in range(0, len(owner), COMPARED_AT_ONCE):
            one, two = lead[lo : lo + COMPARED_AT_ONCE], owner[lo : lo + COMPARED_AT_ONCE]
            apart = distance(prints[one], prints[two])
            near[lo : lo + COMPARED_AT_ONCE] = hit = apart <= most
            hit = hit & (one != two)
            found.append(np.stack([one[hit], two[hit], apart[hit]]))
        free &= ~near
        stays = (np.bincount(bucket, free) > 0)[bucket]
        owner, bucket, free = owner[stays], bucket[stays], free[stays]
    return found


def _partners(one: np.ndarray, two: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's pairs that with the first row and that with the nearest."""
    a, b, d = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([apart, apart])
    picked = []
    for order in (np.lexsort((b, a)), np.lexsort((b, d, a))):
        picked.append(order[np.diff(a[order], prepend=-1) != 0])
    picked = np.unique(np.concatenate(picked))
    return a[picked], b[picked], d[picked]


def _near_in_groups(most: int):
    def pairs(group: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        distinct, number = np.unique(nodes, return_inverse=True)
        order = np.argsort(number, kind="stable")
        one, two, apart = _within(group[order], prints[order], most)
        a, b, d = _partners(number[order][one], number[order][two], apart)
        return pa.RecordBatch.from_arrays([pa.array(distinct[a]), pa.array(distinct[b]), pa.array(d)], ["a", "b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for given in batches:  # sorted by group, whose last one may go on in the next batch
            if not given.num_rows:
                continue
            held.append(np.stack([given.column(c).to_numpy(zero_copy_only=False) for c in ("banded", "node", *WORD_COLUMNS)]))
            rows += given.num_rows
            if rows < 10_000 or held[-1][0, -1] >> BAND_BITS == held[0][0, 0] >> BAND_BITS:
                continue
            table = np.concatenate(held, axis=1)
            groups = table[0] >> BAND_BITS
            cut = int(np.searchsorted(groups, groups[-1]))
            yield pairs(table[0, :cut], table[1, :cut], table[2:, :cut].T.copy().view(np.uint64))
            held, rows = [table[:, cut:]], table.shape[1] - cut
        if rows:
            table = np.concatenate(held, axis=1)
            yield pairs(table[0], table[1], table[2:].T.copy().view(np.uint64))

    return run


def near_pairs(prints: DataFrame, most: int) -> DataFrame:
    """(a, b): of each node the least and the nearest of those met in each group whose wide fingerprints differ in ``most`` bits or fewer.

    ``prints`` has a row (node, bands, WORD_COLUMNS) for each node. Two meet if
    one of their bands differs in two bits or fewer: then one of its three parts
    is equal, and in the task that owns this part's value the balls of radius
    one around the rest have a variant in common.
    """
    value = F.col("band.value").cast("long")
    numbered = F.transform("bands", lambda v, k: F.struct(k.alias("number"), v.alias("value")))
    keys = [
        F.shiftleft(F.col("band.number").cast("long"), 42) + F.lit(k << 40) + F.shiftleft(value.bitwiseAND(F.lit(equal)), BAND_BITS) + value
        for k, equal in enumerate(PARTS_OF_BAND)
    ]
    banded = prints.select("node", *WORD_COLUMNS, F.explode(numbered).alias("band"))
    banded = banded.select("node", *WORD_COLUMNS, F.explode(F.array(*keys)).alias("banded"))
    met = (
        banded.repartition(F.shiftright("banded", BAND_BITS))
        .sortWithinPartitions("banded")
        .select("banded", "node", *WORD_COLUMNS)
        .mapInArrow(_near_in_groups(most), "a long, b long, apart long")
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every linked node: the smallest node that it reaches.

    Alternating large and small stars; each round is written, so a lost
    executor costs one round. A node of many links is pre-aggregated.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")
        # Large star: larger neighbours of a node hang on its smallest.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = scratch.write(large.where("u <> v"), "large")
        # Small star: smaller neighbours and the node itself hang on the smallest.
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("low")), "least")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        new = scratch.write(small.where("u <> v").distinct(), "edges")
        sums = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = tuple(new.agg(*sums).first()) == tuple(edges.agg(*sums).first())
        scratch.drop(edges, low, large, least)
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(simhash(docs, size), "fingerprints")
    nodes = scratch.write(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    links = near_links(nodes.select("fingerprint"), radius, prefix_bits_for(nodes.count()))
    roots = components(links, scratch)
    placed = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = scratch.write(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.write(placed.join(least, "root").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
