"""What new rows are held against: addresses, titles and fingerprints of accepted ones, as a persistent index.

Every accepted row is a few index rows, one for each key under which a later
row can meet it: its address, its title, and the choices of equal blocks of
its fingerprint. They are Parquet, parted by batch, kind and bucket of the key.
A batch reads the buckets that its own keys fall into and joins its keys with
them; the history is not read as a whole, and never met with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.simhash import hamming
from ..shared import no_path
from .similarity import print_keys

#: Where a hit of a kind is kept.
KINDS = {"url": "url_canonical", "title": "title_norm", "print": "simhash"}
INDEX = "key string, print long, seq long, batch long, kind string, bucket int"


def comparators(rows: DataFrame, threshold: int, shared: int = 1, *more: str) -> DataFrame:
    """(kind, key, print, *more) for every key of each row of ``rows``; what is null or empty has none."""
    entry = lambda kind, key, value=None: F.struct(F.lit(kind).alias("kind"), key.alias("key"), (F.lit(None).cast("long") if value is None else value).alias("print"))
    keys, _ = print_keys(F.col("simhash"), threshold, shared)
    prints = [entry("print", F.when(F.col("simhash").isNotNull(), F.concat(k["choice"].cast("string"), F.lit(":"), F.array_join(k["bits"].cast("array<string>"), ":"))), F.col("simhash")) for k in keys]
    entries = F.array(entry("url", F.col("url_canonical")), entry("title", F.col("title_norm")), *prints)
    return rows.select(*more, F.explode(entries).alias("e")).select("e.*", *more).where("key is not null and key <> ''")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


class ComparatorIndex:
    """Comparators below ``folder``; ``buckets`` for each kind, ``shared`` blocks of a fingerprint in one key."""

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 3, buckets: int = 16, shared: int = 1):
        self.spark, self.folder, self.threshold, self.buckets, self.shared = spark, folder.rstrip("/"), threshold, buckets, shared
        self.until, self.moved = 1 << 62, 0

    def before(self, batch: int, moved: int = 0) -> ComparatorIndex:
        """The index as it was before ``batch``, with ``moved`` added to the numbers of its rows."""
        index = ComparatorIndex(self.spark, self.folder, self.threshold, self.buckets, self.shared)
        index.until, index.moved = batch, moved
        return index

    def add(self, rows: DataFrame, batch: int) -> None:
        """Accepted ``rows`` (seq, url_canonical, title_norm, simhash) of ``batch``; the same batch again replaces its rows."""
        said = comparators(rows, self.threshold, self.shared, "seq").withColumn("bucket", bucket_of(self.buckets))
        dealt = said.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "key")
        dealt.write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{self.folder}/batch={batch}")

    def told(self, asked: DataFrame) -> DataFrame:
        """(kind, key, print, seq), the least seq for each comparator in the buckets of ``asked`` (kind, key)."""
        touched = asked.groupBy("kind").agg(F.collect_set(bucket_of(self.buckets)).alias("buckets")).collect()  # as many numbers as there are buckets
        try:
            rows = self.spark.read.schema(INDEX).parquet(self.folder)
        except Exception as error:
            if not no_path(error):
                raise
            rows = self.spark.createDataFrame([], INDEX)
        here = F.lit(False)
        for row in touched:
            here = here | ((F.col("kind") == row["kind"]) & F.col("bucket").isin(row["buckets"]))
        rows = rows.where((F.col("batch") < self.until) & here)
        return rows.groupBy("kind", "key", "print").agg((F.min("seq") + self.moved).alias("seq"))


def against_history(rows: DataFrame, known: DataFrame | ComparatorIndex, threshold: int) -> DataFrame:
    """``rows`` with url_canonical_stood, title_norm_stood and simhash_stood: the earliest known row that has each, or a fingerprint near it."""
    shared = known.shared if isinstance(known, ComparatorIndex) else 1
    asked = comparators(rows, threshold, shared).distinct()
    if isinstance(known, ComparatorIndex):
        told = known.told(asked)
    else:
        told = comparators(known, threshold, shared, "seq").groupBy("kind", "key", "print").agg(F.min("seq").alias("seq"))
    given = told.withColumnRenamed("print", "other")
    near = F.col("print").isNull() | (hamming(F.col("print"), F.col("other")) <= threshold)
    met = asked.join(given, ["kind", "key"]).where(near)
    met = met.groupBy("kind", F.when(F.col("print").isNull(), F.col("key")).otherwise(F.col("print").cast("string")).alias("what")).agg(F.min("seq").alias("seq"))
    for kind, column in KINDS.items():
        own = met.where(F.col("kind") == kind).select(F.col("what").alias(f"_{kind}"), F.col("seq").alias(f"{column}_stood"))
        rows = rows.join(own, F.col(column).cast("string") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    return rows
