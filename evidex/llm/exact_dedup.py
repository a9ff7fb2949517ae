"""Exact deduplication by deterministic block naming.

Every normalised text is cut into fixed-size blocks. The distinct blocks are
sorted and each gets an integer name; adjacent pairs of names are then named
in turn until one integer is left for each document. Names are assigned to
distinct values, so two documents share (number of blocks, last name) exactly
when their texts are equal. No hash decides that; a 64-bit one only tells
texts of one doc_id apart.

Defined cases: null text is the empty text (one empty block); a null doc_id is
a document like any other; a row repeated under one doc_id is one more member
of its group and is returned as often as it came; a very long text is as many
rows as it has blocks; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import whole, without_white_space

#: Code points in a block of the first level.
BLOCK = 1024


def _named(pairs: DataFrame, cols: list[str], scratch: Scratch, level: int) -> DataFrame:
    """Distinct values of ``cols`` with an integer ``name``.

    The values are sorted within their hash partition and numbered, which
    gives the same names again if a lost task is repeated.
    """
    values = pairs.select(*cols).distinct().sortWithinPartitions(*cols)
    return scratch.write(values.withColumn("name", F.monotonically_increasing_id()), f"names{level}")


def block_identity(docs: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """One row per ``key`` with ``name``: texts of as many blocks are equal exactly when their names are.

    ``key`` must tell different texts apart; rows repeated under one key hold the same text.
    """
    scratch = Scratch(docs.sparkSession, "block-naming")
    # A pattern cuts in one pass; substring() would count from the start for each block.
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    blocks = docs.select(key, F.posexplode_outer(cut).alias("pos", "block")).select(
        key, F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), F.coalesce("block", F.lit("")).alias("block")
    )
    names = _named(blocks, ["block"], scratch, 0)
    level = scratch.write(blocks.join(names, "block").select(key, "pos", "name"), "level0")
    scratch.drop(names)
    depth, longest = 0, level.agg(F.max("pos")).first()[0] or 0
    first_of = lambda: scratch.write(level.where("pos = 0").select(key, F.lit(depth).alias("depth"), "name"), "first")
    done = first_of()
    while longest > 0:
        depth, longest = depth + 1, longest // 2
        side = F.col("pos") % 2
        pairs = level.groupBy(key, F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        # A document with one name left is done; an odd last name is paired with -1.
        pairs = scratch.write(pairs.where("pos > 0 or right >= 0"), f"pairs{depth}")
        scratch.drop(level)
        names = _named(pairs, ["left", "right"], scratch, depth)
        level = scratch.write(pairs.join(names, ["left", "right"]).select(key, "pos", "name"), f"level{depth}")
        scratch.drop(pairs, names)
        done = done.unionByName(first_of())
    scratch.drop(level)
    return done.groupBy(key).agg(F.max(F.struct("depth", "name"))["name"].alias("name"))


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, text_hash) for each row of ``docs``.

    Texts are equal when identical without white space. Of equal ones the
    longest original stays, then the smallest doc_id (null before others), then
    one of the repeated rows.
    """
    text = whole(F.col("text"))
    rows = docs.select("doc_id", text.alias("text")).select(
        F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"),
        F.char_length("text").cast("long").alias("n"),
        F.monotonically_increasing_id().alias("place"),
        without_white_space(F.col("text")).alias("normal"),
    )
    names = block_identity(rows, "key", "normal", block)
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    sized = rows.select(
        "key",
        "n",
        "place",
        F.ceil(F.char_length("normal") / block).cast("long").alias("blocks"),
        F.sha2("normal", 256).alias("text_sha256"),
    )
    # Written, so that the place that tells copies of one row apart is the same for all that reads it.
    placed = scratch.write(sized.join(names, "key"), "placed")
    best = placed.groupBy("blocks", "name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "key", "place")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    best = scratch.write(best, "best")
    return placed.join(best, ["blocks", "name"]).select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("best.key.doc_id").alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("best.place")).alias("kept"),
        "text_sha256",
        F.col("key.h").alias("text_hash"),
    )
