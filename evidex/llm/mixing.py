"""Mixing sources to target weights: Efraimidis-Spirakis keys, sorted within a source, prefix-summed to token budgets.

A source's size is the number of words of its documents. Sources share a
budget by weight; a target stops at ``most`` times its source's size and what
is over goes to the others by their weights. A source gives complete epochs
first. What is left of its target is filled by a weighted sample without
replacement: each document draws the key -ln(u) / weight, documents are taken
in the order of their keys, and the one at the edge gives only as many words
as are left. u comes from the MD5 of a seed, doc_id and text, so reruns agree.

Everything is DataFrame functions. Texts are read once; what is sorted is a
short row for each document, dealt by ranges of (source, key), so a source
that holds a third of all documents fills many tasks. To the driver come
three numbers for each round of sharing.

Defined cases: a null text has no words; a null source is a source of its own,
after all others; a null doc_id draws by its text alone; repeated rows draw
one key and are taken one after the other; a source without words has target 0
and gives nothing; an empty table gives an empty result; a weight that is null,
NaN or not over 0 counts as 1; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running_sum
from .scratch import Scratch
from .text import whole

#: Shares of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a share of all sizes, and how often a source may be read.
BUDGET, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1, from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), text).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size).

    In each round the sources that are not full share what the full ones leave;
    those that would get more than ``most`` times their size are full from then
    on. A round makes one source full at least, or is the last.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "mixing")
    order = F.struct(F.col("source").isNull().alias("without"), "source")
    named = numbered(sizes.withColumn("name", order), ["name"], name="place", write=scratch.write)
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    state = scratch.write(named.select("source", "source_size", share.cast("double").alias("weight"), F.lit(False).alias("full")), "state")
    total = (state.agg(F.sum("source_size")).first()[0] or 0) * budget
    while True:
        row = state.agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most)), F.lit(0)), F.sum(F.when(~F.col("full"), F.col("weight")))
        ).first()
        rate = (total - row[0]) / row[1] if row[1] else 0.0
        above = ~F.col("full") & (F.col("weight") * F.lit(rate) > F.col("source_size") * most)
        if state.where(above).isEmpty():
            break
        state = scratch.write(state.withColumn("full", F.col("full") | above), "state")
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return state.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, key, taken) for each row of ``docs``.

    ``quality`` (doc_id, weight), one row for a doc_id: a document of weight 2
    is twice as likely to be next as one of weight 1, which those have that it
    doesn't name.
    """
    scratch, text = Scratch(docs.sparkSession, "mixing"), whole(F.col("text"))
    size, drawn = F.regexp_count(text, F.lit(WORD)).cast("long"), -F.ln(draw(seed, F.col("doc_id"), text))
    # Texts end here: what is joined and sorted is a short row.
    rows = docs.select("doc_id", "source", size.alias("size"), drawn.alias("drawn"))
    given = F.lit(1.0)
    if quality is not None:
        rows, given = rows.join(quality.where("doc_id is not null").select("doc_id", F.col("weight").cast("double").alias("given")), "doc_id", "left"), F.col("given")
    sound = F.when((given > 0) & ~F.isnan(given), given).otherwise(F.lit(1.0))
    rows = scratch.write(rows.select("doc_id", "source", "size", (F.col("drawn") / sound).alias("key")), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = scratch.write(targets(sizes, weights, budget, most, scratch), "shares")
    ranked = running_sum(rows, "size", ["key", "doc_id", "size"], ["source"], "before", scratch.write)
    asked = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = asked - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    by_source = F.struct("source").alias("by")
    joined = ranked.withColumn("by", by_source).join(shares.select(by_source, "source_size", "target"), "by")
    return joined.select("doc_id", "source", "size", "source_size", "target", "key", taken.cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for documents that are labelled good, 1/2 for bad ones; of several labels the mean counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    return known.agg(F.pow(F.lit(4.0), F.avg("quality") - 0.5).alias("weight"))
