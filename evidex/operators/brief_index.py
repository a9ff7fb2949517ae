"""Brief retrieval by a threshold algorithm: posting lists from rare to common, until nothing unread can enter the top.

A row's score is the number of the prompt's grams that its text holds, plus a
static part that the caller gives (nearness and news). A row that is in none of
the lists read, and not among the best by the static part, can have no more
than one for each list that is left plus the static part that the others have
at most. When that is less than what the last of the top has for certain,
reading stops; the rows that may still be in the top are completed from the
lists that are left, where only their ranges are read. Exact, ties go to the
least key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sliding_tokens
from .ordered import numbered

#: Rows of a range, folders of lists, and rows that are taken as the best by the static part, for each of the top.
RANGE, BUCKETS, STATIC = 1 << 14, 32, 16


def prompt_grams(spark: SparkSession, prompt: str) -> list[str]:
    found = spark.range(1).select(sliding_tokens(F.lit(prompt), 2, True).alias("g")).first()["g"]
    return sorted(set(found))


class BriefIndex:
    """Posting lists below ``folder``: for each gram, and each range of row numbers, the rows whose text holds it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: Postings that the last search read, and those of all its grams.
        self.read, self.all = 0, 0

    def build(self, rows: DataFrame, key: str, text: str) -> None:
        given = rows.select(F.col(key).alias("key"), F.array_distinct(sliding_tokens(F.col(text), 2, True)).alias("grams"))
        docs = numbered(given, ["key"], name="doc")
        bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
        docs.select("doc", "key").write.mode("overwrite").parquet(f"{self.folder}/keys")
        said = docs.select((F.col("doc") / RANGE).cast("int").alias("range"), "doc", F.explode("grams").alias("gram"))
        lists = said.groupBy("gram", "range").agg(F.array_sort(F.collect_list("doc")).alias("docs")).select("gram", "range", F.size("docs").alias("n"), "docs", bucket.alias("bucket"))
        lists.repartition("bucket").sortWithinPartitions("bucket", "gram", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/lists")

    def _lists(self, grams: list[str]) -> DataFrame:
        buckets = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).distinct().collect()
        return self.spark.read.parquet(f"{self.folder}/lists").where(F.col("bucket").isin([r[0] for r in buckets]) & F.col("gram").isin(grams))

    def top(self, prompt: str, static: DataFrame, top: int = 15, write: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
        """(key, score) of the ``top`` rows by score, then key; ``static`` (key, static) has the static part of rows that have one, others have 0."""
        grams = prompt_grams(self.spark, prompt)
        keys = self.spark.read.parquet(f"{self.folder}/keys")
        # Moved up, so that no part is under 0; the bounds below count on that.
        moved = min(static.agg(F.min("static")).first()[0] or 0.0, 0.0)
        own = write(keys.join(static.select("key", "static"), "key", "left").select("doc", "key", (F.coalesce("static", F.lit(0.0)) - moved).alias("static")))
        best = [r["static"] for r in own.orderBy(F.desc("static")).select("static").limit(top * STATIC).collect()]
        # What a row outside the best by the static part has at most.
        rest = best[-1] if len(best) == top * STATIC else 0.0
        sizes = {r["gram"]: r["n"] for r in self._lists(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()} if grams else {}
        order = sorted(sizes, key=lambda g: (sizes[g], g))
        self.all, done = sum(sizes.values()), 0
        counts = write(own.select("doc").where("false").withColumn("n", F.lit(0).cast("long")))
        while True:
            left = len(order) - done
            held = own.join(counts, "doc", "left").select("doc", "key", "static", F.coalesce("n", F.lit(0)).alias("n"), (F.col("static") + F.coalesce("n", F.lit(0))).alias("sure"))
            # Rows that can be told apart from those that nothing is known of.
            seen = held.where((F.col("n") > 0) | (F.col("static") >= rest))
            sure = [r["sure"] for r in seen.orderBy(F.desc("sure")).select("sure").limit(top).collect()]
            least = sure[-1] if len(sure) == top else -1.0
            if left == 0 or left + rest < least:
                break
            more = order[done : done + max(1, left // 4)]
            found = self._lists(more).select(F.explode("docs").alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
            counts = write(counts.unionByName(found).groupBy("doc").agg(F.sum("n").alias("n")))
            done += len(more)
        self.read = sum(sizes[g] for g in order[:done])
        if left == 0:
            chosen = held
        else:
            open_ = write(seen.where(F.col("sure") + left >= least).withColumn("range", (F.col("doc") / RANGE).cast("int")))
            here = [r["range"] for r in open_.select("range").distinct().collect()]
            lists = self._lists(order[done:]).where(F.col("range").isin(here)).select(F.explode("docs").alias("doc"))
            others = lists.join(open_.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("m"))
            chosen = open_.join(others, "doc", "left").withColumn("sure", F.col("sure") + F.coalesce("m", F.lit(0)))
        return chosen.select("key", (F.col("sure") + moved).alias("score")).orderBy(F.desc("score"), "key").limit(top)
