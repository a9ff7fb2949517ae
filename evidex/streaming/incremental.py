"""Incremental runs: each micro-batch of raw items is deduplicated against the accepted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import EngineConfig
from ..operators.comparators import ComparatorIndex
from ..operators.dedup import layered_dedup, prepare

RAW = "url string, title string, content string, published_at timestamp_ntz, time_source string, prefilter_drop string, seq long"


def raw_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_at_once).json(folder)


def dedup_batch(config: EngineConfig, folder: str, window_start):
    """A foreachBatch function: accepted rows and the ledger, one partition for each batch.

    Accepted rows go into an index, which never expires, so it is a table and
    not streaming state. A batch that is run again overwrites its own partition
    and compares only with earlier ones, so a restart changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        keep = lambda df: df.checkpoint()
        index = ComparatorIndex(batch.sparkSession, f"{folder}/comparators", config.hamming_threshold)
        rows = keep(prepare(batch, config, window_start))
        # Earlier rows come before all of this batch, whatever their numbers were.
        decided = keep(layered_dedup(rows, index.before(number, -(1 << 61)), config.hamming_threshold, keep))
        new = keep(rows.join(decided.where("reason is null").select("seq"), "seq", "left_semi").select("seq", "url_canonical", "title_norm", "simhash"))
        index.add(new, number)
        new.write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        lost = rows.join(decided.where("reason is not null"), "seq").select("seq", "item_id", "url", "title", "reason", "dup_of")
        lost.write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")

    return run


def run_available(spark: SparkSession, source: str, folder: str, config: EngineConfig, window_start, files_at_once: int = 100) -> None:
    """Take in all files that are there, then stop; the next call goes on from the checkpoint."""
    stream = raw_stream(spark, source, files_at_once)
    writer = stream.writeStream.foreachBatch(dedup_batch(config, folder, window_start))
    writer.option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True).start().awaitTermination()
