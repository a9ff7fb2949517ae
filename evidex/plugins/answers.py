"""A log of answers: each question is put to the judge once, whoever reads the answer and whatever fails.

A question is one row's content under a task and a model. Questions that the
log holds are not asked. The others are numbered over the whole table, in the
order of their keys, and cut into batches of a fixed size, so what a batch
holds doesn't depend on how rows are dealt to tasks. A task writes each batch's
answers to the journal as soon as it has them, before anything reads them, and
joins its files now and then, so their number doesn't follow that of batches; a
task that runs again, or a call that does after a failed one, finds them there.
When a call's tasks have ended, the journal goes into the log, one row for a
question. Consumers read the log, never the judge.

The journal is written through Arrow's file systems (local paths, HDFS, S3,
GCS by their URIs); the log is a Parquet table in the same folder. Two attempts
of one task that run at the same time may both ask; the log keeps one answer.
What a judge doesn't answer, or an error, is not logged: the row's answer is
null, and the next call asks again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..shared import delete_file, delete_folder, names_in, no_path, read_file, shared_folder, write_file

LOG = "key string, task string, answer string, asked_in string"


def parsed(text: str, size: int) -> list[str | None]:
    """One answer for each of ``size`` rows: a list, alone or under a name, whose elements may say their place in ``i``."""
    found = json.loads(text)
    if isinstance(found, dict):
        found = found.get("results") or found.get("pairs") or []
    by_place = {v.get("i", n) if isinstance(v, dict) else n: v for n, v in enumerate(found)}
    return [json.dumps(by_place[n]) if n in by_place else None for n in range(size)]


#: Batches, and characters, after which a task's files are joined.
JOIN_BATCHES, JOIN_CHARS = 1000, 4 << 20


class Journal:
    """What one attempt of a task writes: a file for each batch when it has its answers, joined into one after every so many.

    So there are as many files as there are joined ones, and at most JOIN_BATCHES
    more for each task that runs. An attempt deletes only its own files, and
    after the joined one is there.
    """

    def __init__(self, folder: str):
        self.folder, self.attempt = folder, uuid.uuid4().hex
        self.lines, self.files, self.count, self.chars = [], [], 0, 0

    def batches(self) -> set[str]:
        """Batches that any attempt has written."""
        found = set()
        for name in names_in(self.folder):
            if name.endswith(".json"):
                # A file that goes meanwhile has been joined by another attempt.
                lines = (read_file(f"{self.folder}/{name}") or b"").decode().splitlines()
                found |= {b for b in (json.loads(x).get("batch") for x in lines) if b}
        return found

    def add(self, lines: list[str]) -> None:
        name = f"{self.folder}/{self.attempt}-{self.count}.json"
        write_file(name, "\n".join(lines).encode())
        self.count += 1
        self.lines += lines
        self.files.append(name)
        self.chars += sum(map(len, lines))
        if len(self.files) >= JOIN_BATCHES or self.chars >= JOIN_CHARS:
            self.join()

    def join(self) -> None:
        if len(self.files) > 1:
            write_file(f"{self.folder}/{self.attempt}-to-{self.count}.json", "\n".join(self.lines).encode())
            for name in self.files:
                delete_file(name)
        self.lines, self.files, self.chars = [], [], 0


class AnswerLog:
    """Answers in a folder that all executors share; without one the log lasts as long as the shared folder of this run."""

    def __init__(self, spark: SparkSession, folder: str | None = None, model: str = "judge"):
        self.spark, self.model = spark, model
        self.folder = (folder or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}").rstrip("/")

    def read(self) -> DataFrame:
        """(key, task, answer, asked_in), one row for a question."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except Exception as error:
            if not no_path(error):
                raise
            rows = self.spark.createDataFrame([], LOG)
        return rows.groupBy("key").agg(F.min(F.struct("task", "answer", "asked_in")).alias("a")).select("key", "a.*")

    def recover(self) -> None:
        """Take in what calls that did not end have left in the journal."""
        for call in names_in(f"{self.folder}/journal", folders=True):
            self._take_in(f"{self.folder}/journal/{call}")

    def _take_in(self, journal: str) -> None:
        try:
            rows = self.spark.read.schema(LOG).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(journal)
        except Exception as error:
            if not no_path(error):
                raise
            return
        # What has been taken in before the journal went is not added again.
        new = rows.where("key is not null and answer is not null").join(self.read().select("key"), "key", "left_anti")
        new.select("key", "task", "answer", "asked_in").write.mode("append").parquet(f"{self.folder}/log")
        delete_folder(journal)

    def ask(self, rows: DataFrame, judge, task: str, keys: list[str], size: int, asked_in: str = "") -> DataFrame:
        """``keys`` of each of ``rows`` with its answer, a JSON text or null; asks what the log doesn't hold."""
        self.recover()
        content = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        key = F.sha1(F.concat_ws("\n", F.lit(self.model), F.lit(task), content).cast("binary"))
        # Written: whatever the content comes from, what was asked is what is read back.
        asked = rows.select(*keys, content.alias("content"), key.alias("key")).checkpoint()
        self._put(asked, judge, task, keys, size, asked_in)
        return asked.join(self.read().select("key", "answer"), "key", "left").select(*keys, "answer")

    def _put(self, asked: DataFrame, judge, task: str, keys: list[str], size: int, asked_in: str) -> None:
        order = [f"order_{n}" for n in range(len(keys))]
        first = asked.groupBy("key").agg(F.min(F.struct(*(F.col(k).alias(o) for k, o in zip(keys, order)), "content")).alias("r")).select("key", "r.*")
        new = first.join(self.read().select("key"), "key", "left_anti")
        placed = numbered(new, [*order, "key"]).withColumn("batch", F.floor(F.col("place") / size))
        batches = placed.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "key", "content"))).alias("rows")).checkpoint()
        journal = f"{self.folder}/journal/{uuid.uuid4().hex}"
        write_file(f"{journal}/task", task.encode())

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # A partition's batches are the same at every attempt, so its folder holds what earlier ones have asked.
            own = f"{journal}/{TaskContext.get().partitionId()}"
            held = Journal(own)
            known = held.batches()
            for frame in frames:
                done = 0
                for given in frame["rows"]:
                    names = [r["key"] for r in given]
                    batch = hashlib.sha1("".join(names).encode()).hexdigest()
                    if batch in known:
                        continue
                    try:
                        answers = parsed(judge.answer(task, [json.loads(r["content"]) for r in given]), len(given))
                    except Exception:
                        continue
                    told = [json.dumps({"key": k, "task": task, "answer": a, "asked_in": asked_in}) for k, a in zip(names, answers) if a is not None]
                    held.add([*told, json.dumps({"batch": batch})])
                    done += len(told)
                yield pd.DataFrame({"done": [done]})
            held.join()

        batches.repartition("batch").mapInPandas(run, "done long").agg(F.sum("done")).collect()
        self._take_in(journal)
