"""Channels as a stream: captures that arrive in a folder for each source, a partition and an offset for each of them.

A source's captures are read in the order of their names; its offset is the
last name that was taken in, so a restart goes on behind it and reads nothing
twice. A source whose folder can't be read, or a capture that can't, is a row
that says so, and the others go on. Of each batch, items and failures are
written under its number, which makes a batch that is run again the same.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..shared import names_in, read_file, write_file
from .collect import items_of

CAPTURE = "source_id string, channel string, capture string, url string, status string, body binary"


class _Captures(InputPartition):
    def __init__(self, source: dict, names: list[str]):
        self.source, self.names = source, names


def _captures(folder: str) -> list[str]:
    return [n for n in names_in(folder) if not n.startswith((".", "_"))]


class ChannelReader(DataSourceStreamReader):
    """Options: ``sources``, a JSON list of {id, channel, folder, url}; ``batch``, captures of a task; ``state``, a file of how far each source was read.

    Offsets never go back: a folder that can't be read, or is empty for a while, stays where the state has it.
    """

    def __init__(self, options):
        self.sources = {s["id"]: s for s in json.loads(options.get("sources", "[]"))}
        self.most, self.bytes, self.state = int(options.get("batch", 100)), int(options.get("maxBytes", 600_000)), options.get("state")

    def initialOffset(self) -> dict:
        return {name: "" for name in self.sources}

    def _reached(self) -> dict:
        return json.loads((self.state and read_file(self.state)) or b"{}")

    def latestOffset(self) -> dict:
        reached = self._reached()
        for name, source in self.sources.items():
            try:
                last = max(_captures(source["folder"]), default="")
            except Exception:
                last = ""
            reached[name] = max(last, reached.get(name, ""))
        return reached

    def partitions(self, start: dict, end: dict):
        out = []
        for name, source in self.sources.items():
            after, last = start.get(name, ""), end.get(name, "")
            names = [n for n in _captures(source["folder"]) if after < n <= last] if last > after else []
            out += [_Captures(source, names[at : at + self.most]) for at in range(0, len(names), self.most)]
        return out

    def read(self, partition):
        source = partition.source
        for name in partition.names:
            try:
                body = read_file(f"{source['folder']}/{name}")
                status = "200" if body is not None else "FileNotFoundError"
            except Exception as error:
                body, status = b"", type(error).__name__
            yield source["id"], source["channel"], name, source.get("url") or source["folder"], status, (body or b"")[: self.bytes]

    def commit(self, end: dict) -> None:
        """How far each source was read is kept; captures stay for audits."""
        if self.state:
            reached = self._reached()
            write_file(self.state, json.dumps({n: max(at, reached.get(n, "")) for n, at in end.items()} | {n: at for n, at in reached.items() if n not in end}).encode())


class ChannelSource(DataSource):
    """spark.readStream.format("evidex_channels").option("sources", ...)"""

    @classmethod
    def name(cls):
        return "evidex_channels"

    def schema(self):
        return CAPTURE

    def streamReader(self, schema):
        return ChannelReader(self.options)


def take_in(spark: SparkSession, sources: list[dict], folder: str, batch: int = 100) -> None:
    """Take in every capture that is there, then stop; the next call goes on behind them.

    Items lie in ``folder``/items, failures in ``folder``/failures, by batch.
    """
    spark.dataSource.register(ChannelSource)
    given = {"sources": json.dumps(sources), "batch": str(batch), "state": f"{folder}/_offsets.json"}
    stream = spark.readStream.format("evidex_channels").options(**given).load()
    known = [(s["id"], s["channel"], s.get("domains") or [], s.get("article_url_pattern")) for s in sources]

    def run(responses: DataFrame, number: int) -> None:
        held = responses.checkpoint()  # read once; items and failures are of the same bytes
        registry = held.sparkSession.createDataFrame(known, "source_id string, kind string, domains array<string>, article_url_pattern string")
        # Every capture of a source counts, so each is a source of its own until its items are read.
        name = F.concat_ws("\x1f", "source_id", "capture")
        one = held.select(name.alias("source_id"), "channel", F.lit(0).alias("mirror"), "url", "status", "body")
        names = held.join(registry, "source_id").select(name.alias("id"), "channel", "domains", "article_url_pattern").distinct()
        items, failures = items_of(names, one)
        own = lambda df: df.withColumn("source_id", F.substring_index("source_id", "\x1f", 1))
        own(items).write.mode("overwrite").parquet(f"{folder}/items/batch={number}")
        own(failures).write.mode("overwrite").parquet(f"{folder}/failures/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True)
    writer.start().awaitTermination()
