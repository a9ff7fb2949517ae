"""Line deduplication by the number of documents that hold a line.

Lines are exploded, normalised and hashed to 128 bits; documents are counted
per hash after a distinct on (hash, document), so a line of every document
costs one row for each. Lines over the threshold are dropped by position, but
for those of the largest doc_id, and the rest is joined again in order: each
position is marked once in its text's list of lines.

Defined cases: a null or empty text is one empty line; lines are whatever
stands between \\n, so \\r stays part of a line (its key is stripped); rows
that repeat a doc_id count as one document, and each keeps its own lines; a
null doc_id counts as one document, before all others; a very long text is one
row, read once; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import WHITE_SPACE, lower_ascii, whole

MIN_CHARS = 20
MIN_DOCS = 3
#: Characters of texts that one output batch may hold before it is sent on.
BATCH_CHARS = 4 << 20


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        texts, n_lines, n_dropped, size, first = [], [], [], 0, 0
        ids = given.column("doc_id")

        def batch() -> pa.RecordBatch:
            columns = [ids.slice(first, len(texts)), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])

        for text, drop in zip(given.column("text"), given.column("drop")):
            text = text.as_py()
            if drop.is_valid:
                lines = text.split("\n")
                stays = bytearray(b"\x01") * len(lines)
                for at in drop.as_py():
                    stays[at] = 0
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - sum(stays))
                text = "\n".join([line for line, stay in zip(lines, stays) if stay])
            else:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
            texts.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                yield batch()
                first, size = first + len(texts), 0
                texts, n_lines, n_dropped = [], [], []
        if texts:
            yield batch()


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs``; text is what is left."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = lower_ascii(F.btrim(F.col("line"), F.lit(WHITE_SPACE)))
    lines = (
        rows.select(F.struct("doc_id", "h").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("row", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("row", "pos", F.struct(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")).alias("line"))
    )
    common = (
        lines.select("line", F.struct(F.col("row.doc_id")).alias("doc"))
        .distinct()
        .groupBy("line")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last"))
        .where(F.col("n_docs") >= min_docs)
        .select("line", "last")
    )
    # Written first, so that both sides of the join come from a shuffle and a hot line can be split.
    common = scratch.write(common, "common")
    dropped = (
        lines.join(common, "line")
        .where(F.struct(F.col("row.doc_id")) != F.col("last"))
        .groupBy("row")
        .agg(F.collect_set("pos").alias("drop"))
    )
    rows = rows.withColumn("row", F.struct("doc_id", "h")).join(dropped, "row", "left").select("doc_id", "text", "drop")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_reassembled, f"doc_id {kind}, n_lines long, n_dropped long, text string")
