"""A full-text index for substring search: posting lists of character trigrams, gap-coded, as bucketed Parquet.

Rows are numbered over the whole table; a posting list names, for one trigram
and one range of 65 536 numbers, the rows whose text holds it, each by its
distance to the one before. Lists lie in folders by a hash of the trigram's
first two characters and are sorted by trigram, so a query reads some row
groups of a few folders. The lists of the query's trigrams are intersected
range by range, the rarest first; texts are read of the rows that are left,
from the folders of their ranges, and decide. A query of two characters meets every trigram that
begins with them; texts end in two marks, so their last characters begin one.

Case is folded by lower(). A null text is the empty text; a null key is a key
like any other; the query is what is looked for, however it is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import numbered

#: Characters of a gram, rows of a range, folders of lists, and what ends a text.
GRAM, RANGE, BUCKETS, END = 3, 1 << 16, 64, "\x00\x00"


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def grams(text: Column) -> Column:
    """Distinct trigrams of a text, in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit(END)), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(gram, F.lit(GRAM - 1))), F.lit(BUCKETS)).cast("int")


def _gaps(numbers: Column) -> Column:
    """Ascending numbers as the first of them and the distances from each to the next; both are short in Parquet."""
    return F.zip_with(numbers, F.concat(F.array(F.lit(0)), F.slice(numbers, F.lit(1), F.size(numbers) - 1)), lambda a, b: (a - b).cast("int"))


class GramIndex:
    """The index below ``folder``; ``build`` writes it, searches read it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, rows: DataFrame, key: str, texts: list[str]) -> None:
        """Index ``texts`` of each of ``rows``; they are searched each for itself."""
        # Another column's text begins after the end of the one before.
        text = F.concat_ws(END, *(folded(F.col(t)) for t in texts))
        given = rows.select(F.col(key).alias("key"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
        docs = numbered(given, ["key", "digest"], name="doc").select((F.col("doc") / RANGE).cast("int").alias("range"), (F.col("doc") % RANGE).cast("int").alias("doc"), "key", "text")
        docs.repartition("range", F.floor(F.col("doc") / 4096)).sortWithinPartitions("range", "doc").write.mode("overwrite").partitionBy("range").parquet(f"{self.folder}/docs")
        said = self.spark.read.parquet(f"{self.folder}/docs").select("range", "doc", F.explode(grams(F.col("text"))).alias("gram"))
        lists = said.groupBy("gram", "range").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
        lists = lists.select("gram", F.col("range").cast("int").alias("range"), F.size("docs").alias("n"), _gaps(F.col("docs")).alias("gaps"), _bucket(F.col("gram")).alias("bucket"))
        lists.repartition("bucket").sortWithinPartitions("bucket", "gram", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/lists")

    def lists(self, query: str) -> DataFrame:
        """(asked, range, gaps): the posting lists that the query's trigrams meet; ``asked`` numbers these."""
        wanted = query.lower()
        if len(wanted) < GRAM:
            asked, where = [wanted], F.startswith(F.col("gram"), F.lit(wanted))
        else:
            asked = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
            where = F.col("gram").isin(asked)
        starts = self.spark.createDataFrame([(a,) for a in asked], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()
        rows = self.spark.read.parquet(f"{self.folder}/lists").where(F.col("bucket").isin([r["b"] for r in starts]) & where)
        return rows.select(F.lit(wanted).alias("asked") if len(wanted) < GRAM else F.col("gram").alias("asked"), "range", "n", "gaps").withColumn("of", F.lit(len(asked)))

    def candidates(self, query: str) -> DataFrame:
        """(range, doc): rows that hold every trigram of the query, somewhere."""

        def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for number, lists, of in zip(frame["range"], frame["lists"], frame["of"]):
                    named: dict[str, list[np.ndarray]] = {}
                    for one in sorted(lists, key=lambda x: x["n"]):
                        named.setdefault(one["asked"], []).append(np.cumsum(np.array(one["gaps"], np.int64)))
                    if len(named) == of:
                        held = None
                        for parts in named.values():
                            docs = np.unique(np.concatenate(parts))
                            held = docs if held is None else np.intersect1d(held, docs, assume_unique=True)
                        yield pd.DataFrame({"range": np.full(len(held), number, np.int32), "doc": held.astype(np.int32)})

        by_range = self.lists(query).groupBy("range").agg(F.collect_list(F.struct("asked", "n", "gaps")).alias("lists"), F.first("of").alias("of"))
        return by_range.mapInPandas(met, "range int, doc int")

    def search(self, query: str) -> DataFrame:
        """(key): the rows that hold ``query`` in one of their texts."""
        if len(query) < GRAM - 1:
            raise ValueError(f"a query has {GRAM - 1} characters or more")
        docs = self.spark.read.parquet(f"{self.folder}/docs")
        found = docs.join(self.candidates(query), ["range", "doc"])
        return found.where(F.contains("text", F.lit(query.lower()))).select("key")


def hybrid_search(index: GramIndex, key: str, vectors: DataFrame, vector: str, query: str, query_vector: list[float] | None, floor: float = 0.62, top: int = 50) -> DataFrame:
    """(key, lexical, similarity) as search.hybrid_search gives them: words from the index, nearness from ``vectors`` (key, vector) of indexed rows."""
    from ..functions.vector import cosine

    if not 2 <= len(query) <= 200:
        raise ValueError("a query has 2 to 200 characters")
    said = index.search(query).select(F.col("key").alias(key), F.lit(True).alias("lexical"))
    near = cosine(F.array(*map(F.lit, query_vector)), F.col(vector)) if query_vector else F.lit(None).cast("double")
    close = vectors.select(key, near.alias("similarity")).where(F.col("similarity") >= floor)
    hits = said.join(close, key, "full_outer").select(key, F.coalesce("lexical", F.lit(False)).alias("lexical"), "similarity")
    return hits.orderBy(F.desc("lexical"), F.desc_nulls_last("similarity"), key).limit(top)
