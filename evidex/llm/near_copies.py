"""Near copies by the Jaccard similarity of word-shingle sets: SimHash proposes, the texts decide.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Every distinct set has a SimHash fingerprint of 320
bits (``wide_fingerprints``), whose 16 bands meet by balls (``near_pairs``):
sets of similarity 0.8 differ in a bit with a probability of 0.151, have one of
16 bands within two bits with 0.9997 and are then 48 bits apart, while unlike
ones are 160 apart. Each set is compared with the least and the nearest that it
meets in each group within ``DIFFERING`` bits.
Where that leaves them in several components, all sets that have met any
meet again under their rarest shingles: two sets of that similarity share one
of the fifth of each that is rarest among them, while what unlike texts share,
a common passage, is not rare. There the smallest and the largest set of a key
meet the others first, then all; sets of one component are not compared, nor
such as can't share enough by what stands behind the key or by their
fingerprints. A comparison looks at sizes and fingerprints first, by which a
pair of similarity 0.8 is passed over with a probability of about a millionth,
then at the texts themselves. The links found contract to components. Neither copies of one text nor the members of a
component are compared with each other; sets that nearly reach the similarity
are, pair by pair.

Defined cases: words are lower-cased in A-Z and parted by white space; a text
of fewer than five words has itself as its only shingle, one without words the
empty set, which equals itself only; rows are told apart by (doc_id, hash of
the text), so rows of one doc_id or of none are kept or dropped each for
itself; of equal rows all are kept or dropped; a very long text is hashed by
itself; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .simhash import BANDS, SHINGLES_AT_ONCE, WORD_COLUMNS, bands_of, components, distance, near_pairs, shingle_hashes, wide_fingerprints
from .text import whole

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of the wide fingerprints over which a pair is passed over: of similarity 0.8 it has 48, five deviations are 32.
DIFFERING = 80
#: Parts into which the partners of one set are dealt.
PARTS = 16


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def band_keys(prints: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each wide fingerprint."""
    return bands_of(prints)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for given in batches:
        texts, done = given.column(2), 0
        while done < given.num_rows:  # as many texts as shingles may be held
            sets, held, first = [], 0, done
            while done < given.num_rows and held < SHINGLES_AT_ONCE:
                sets.append(shingle_set(texts[done].as_buffer().to_pybytes()))
                held, done = held + len(sets[-1]), done + 1
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = wide_fingerprints(sets)
            keys = pa.array(band_keys(prints).astype(np.int32).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
            sizes = pa.array(np.array([len(s) for s in sets], np.int64))
            words = [pa.array(np.ascontiguousarray(word)) for word in prints.view(np.int64).T]
            part = given.slice(first, done - first)
            columns = [part.column(0), part.column(1), pa.array(nodes), bands, sizes, *words]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "bands", "size", *WORD_COLUMNS])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        for node, text in zip(given.column(0), given.column(1)):
            found = shingle_set(text.as_buffer().to_pybytes())
            columns = [np.full(len(found), node.as_py(), np.int64), np.full(len(found), len(found), np.int64), found.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "size", "shingle"])


def rare_keys(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, size, place, before): the shingles of each of ``texts`` (node, text) by which its near copies among them must meet it.

    In the order of how many texts hold them, two sets of the wanted similarity
    share one of their first size - similarity * size + 1 shingles; those that
    one text alone holds need no key.
    """
    said = scratch.write(texts.mapInArrow(_shingled, "node long, size long, shingle long"), "shingles")
    shared = scratch.write(said.groupBy("shingle").count().where("count > 1"), "shared")
    held = said.join(shared, "shingle").groupBy("node").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("held"))
    alone = F.col("size") - F.size("held")
    first = (F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1 - alone).cast("int")
    keys = held.where(first > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("held", 1, first)).alias("nth", "k"), "held")
    before = F.get("held", F.col("nth") - 1)["shingle"].alias("before")
    keys = scratch.write(keys.select(F.col("k.shingle").alias("band"), "node", "size", (F.col("alone") + F.col("nth")).alias("place"), before), "rare-keys")
    scratch.drop(said, shared)
    return keys


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) that are alike, from rows (a, node, size, WORD_COLUMNS, text) that follow the row of a itself."""
    a, size_a, print_a, one = None, 0, None, None
    for given in batches:
        own, nodes, sizes = (given.column(c).to_numpy() for c in ("a", "node", "size"))
        prints = np.stack([given.column(c).to_numpy() for c in WORD_COLUMNS], axis=1)
        texts, found = given.column("text"), []
        for i in range(given.num_rows):
            if own[i] == nodes[i]:
                a, size_a, print_a, one = own[i], sizes[i], prints[i : i + 1], shingle_set(texts[i].as_buffer().to_pybytes())
            elif min(size_a, sizes[i]) >= SIMILARITY * max(size_a, sizes[i]) and distance(print_a, prints[i : i + 1])[0] <= DIFFERING:
                two = shingle_set(texts[i].as_buffer().to_pybytes())
                common = len(np.intersect1d(one, two, assume_unique=True))
                if common >= SIMILARITY * (len(one) + len(two) - common):
                    found.append((a, nodes[i]))
        rows = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells the rows of a table apart: doc_id and the hash of the text."""
    return F.struct(doc_id.cast("long").alias("doc_id"), F.xxhash64(whole(text)).alias("text_hash"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the rows that are near copies, without the first row of each component.

    The first is that of the smallest doc_id, one without a doc_id only if all are, then of the least hash.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), whole(F.col("text")).alias("text"))
    words = ", ".join(f"{c} long" for c in WORD_COLUMNS)
    signed = rows.select("row.*", "text").mapInArrow(_signed, f"doc_id long, text_hash long, node long, bands array<int>, size long, {words}")
    signed = scratch.write(signed, "signed")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    # One row for each set stands for its fingerprint: that of the first document.
    one = F.struct(order.alias("first"), "bands", "size", *WORD_COLUMNS)
    nodes = scratch.write(signed.groupBy("node").agg(F.min_by(one, order).alias("one")).select("node", "one.*"), "nodes")
    signed = signed.select("doc_id", "text_hash", "node")
    met = scratch.write(near_pairs(nodes.select("node", "bands", *WORD_COLUMNS), DIFFERING), "met")
    once = F.struct("first.doc_id", "first.text_hash").alias("row")
    some = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = scratch.write(nodes.join(some, "node").select("node", "size", *WORD_COLUMNS, once), "asked")
    texts = scratch.write(rows.join(asked, "row").dropDuplicates(["node"]).select("node", "size", *WORD_COLUMNS, "text"), "texts")

    def alike(pairs: DataFrame) -> DataFrame:
        """The text of a goes once to each of the parts into which its partners are dealt; these pass it one by one."""
        dealt = scratch.write(pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part"), "b"), "pairs")
        first = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").withColumn("node", F.col("a"))
        others = dealt.withColumnRenamed("b", "node").join(texts, "node")
        both = first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("node") != F.col("a"))
        return scratch.write(both.select("a", "node", "size", *WORD_COLUMNS, "text").mapInArrow(_alike, "a long, b long"), "found")

    links = alike(met)
    keys = scratch.write(rare_keys(texts.select("node", "text"), scratch).join(asked.select("node", *WORD_COLUMNS), "node"), "keys")
    larger, smaller = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    common = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = (smaller >= SIMILARITY * larger - 1e-6) & (common * (1 + SIMILARITY) >= SIMILARITY * (F.col("size_a") + F.col("size_b")) - 1e-6)
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in WORD_COLUMNS), F.lit(0))

    def across(links: DataFrame, ends: bool) -> DataFrame:
        """(a, b) of different components that may be alike; with ``ends`` of the smallest and largest set of each key alone."""
        roots = scratch.write(components(links, scratch), "roots")
        placed = scratch.write(keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed-keys")
        row = F.struct(*(c for c in placed.columns if c != "band"))
        first = placed
        if ends:
            order = F.struct("size", "node")
            first = placed.groupBy("band").agg(F.min_by(row, order).alias("low"), F.max_by(row, order).alias("high"))
            first = scratch.write(first.select("band", F.explode(F.array("low", "high")).alias("x")).select("band", "x.*"), "ends")
        one, two = (frame.select("band", *(F.col(c).alias(f"{c}_{side}") for c in placed.columns if c != "band")) for frame, side in ((first, "a"), (placed, "b")))
        # A pair that has met under the key before this one needs not meet again.
        anew = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
        once = F.col("node_a") != F.col("node_b") if ends else (F.col("node_a") < F.col("node_b")) & anew
        met = one.join(two, "band").where(once & (F.col("root_a") != F.col("root_b")) & enough & (apart <= DIFFERING))
        return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()

    for ends in (True, False):
        links = links.unionByName(alike(across(links, ends)))
    scratch.drop(texts, asked)
    roots = components(links, scratch)
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    placed = scratch.write(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("kept"))
    kept = scratch.write(placed.join(least, "root").select("node", "kept"), "kept")
    return signed.join(kept, "node").where(order != F.col("kept")).select("doc_id", "text_hash")
