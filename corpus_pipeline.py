"""A training-data pipeline over ``documents``: five stages, each on all that its predecessor kept.

Defined cases, for every stage: a null or empty text is the empty text; a row
is what its doc_id and text are, so rows of one doc_id, or of none, are judged
each for itself; very long texts are read whole; an empty table gives an empty
result; columns beside those of documents are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.exact_dedup import exact_dedup
from evidex.llm.near_copies import near_copies, row_key
from evidex.llm.packing import pack
from evidex.llm.queries import tokenizer_path
from evidex.llm.repeats import remove_repeats
from evidex.llm.scratch import Scratch
from evidex.llm.text import whole
from evidex.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half; equal texts have equal scores and stay or go together."""
    docs = docs.select(*COLUMNS)
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("toxicity_score") < 0.5).select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then that of the smallest doc_id.

    A repeated row stays once; a doc_id of null comes before all others.
    """
    docs = docs.select(*COLUMNS)
    found = exact_dedup(docs).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = Scratch(spark, "exact-stage").write(found.where("not kept or n > 1"), "found")
    row = F.struct("doc_id", F.xxhash64(whole(F.col("text"))).alias("text_hash")).alias("row")
    rows, key = docs.select("*", row), F.struct("doc_id", "text_hash").alias("row")
    left = rows.join(found.select(key), "row", "left_anti")
    again = rows.join(found.where("kept").select(key), "row", "left_semi").dropDuplicates(["row"])
    return left.unionByName(again).select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies: five-word Jaccard 0.8 or more, see near_copies.

    SimHash proposes them, by fingerprints of 320 bits, as radius 4 of 64 bits can't find that similarity; the README has the figures.

    Rows are dropped by doc_id and text: another text of the same doc_id stays,
    and so does the first of rows without one. Of groups that tie in doc_id the
    least hash stays; a text without words is like another one only.
    """
    docs = docs.select(*COLUMNS)
    lost = Scratch(spark, "near-copies-stage").write(near_copies(docs).select(F.struct("doc_id", "text_hash").alias("row")).distinct(), "lost")
    return docs.withColumn("row", row_key(F.col("doc_id"), F.col("text"))).join(lost, "row", "left_anti").select(*COLUMNS)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that a document of a smaller doc_id holds.

    Rows of one doc_id are one document for matching, rows without one come
    first by their texts' hashes; a document may end up empty.
    """
    left = remove_repeats(docs, keep=("lang", "source"), whole_characters=True)
    text = F.col("kept").cast("string")
    return left.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 4 096 tokens, repeated rows each for itself."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("near-dedup", near_copies_stage),
    ("suffix-array dedup", suffix_array_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        result = scratch.write(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            scratch.drop(docs)
        docs = result
    return docs
