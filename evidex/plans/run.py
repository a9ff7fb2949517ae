"""One run over a data set: stages in order, each isolated, with its numbers; a run that was broken off goes on where it was."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.versions import Commits

Stage = Callable[[dict[str, DataFrame]], tuple[dict[str, DataFrame], dict]]


def run_id(at: datetime) -> str:
    return at.strftime("RUN-%Y%m%d-%H%M")


def config_hash(*parts: object) -> str:
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


def run_stages(tables: dict[str, DataFrame], stages: list[tuple[str, Stage]], write: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], dict]:
    """(tables, stats): what a stage changes is written before the next reads it; a stage that fails changes nothing."""
    stats: dict = {}
    for name, stage in stages:
        try:
            changed, numbers = stage(dict(tables))
            tables = tables | {k: write(v) for k, v in changed.items()}
            stats[name] = numbers
        except Exception as error:
            stats[name] = {"error": f"{type(error).__name__}: {error}"[:300]}
    return tables, stats


class Run:
    """A run below ``folder``: after each stage a commit names the tables as they are then, and the stage's numbers.

    The same run id goes on after the last commit; a stage that failed was
    committed as failed, with the tables as they were. What was written for a
    stage without a commit is in no commit and is written again.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{name}"
        self.commits = Commits(self.folder)

    def _table(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(entry["schema"]).parquet(f"{self.folder}/{entry['path']}")

    def _written(self, frame: DataFrame) -> dict:
        path = f"tables/{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.folder}/{path}")
        return {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)}

    def go(self, tables: dict[str, DataFrame], stages: list[tuple[str, Stage]]) -> tuple[dict[str, DataFrame], dict]:
        """(tables, stats) after all stages; those that are committed are not run again."""
        last = self.commits.last()
        done = last[1] if last else {"stages": [], "stats": {}, "tables": {}}
        names = [name for name, _ in stages]
        if done["stages"] != names[: len(done["stages"])]:
            raise ValueError(f"the run began with the stages {done['stages']}")
        held = {k: self._written(v) for k, v in tables.items()} if not last else done["tables"]
        if not last:
            self.commits.add(done | {"tables": held})
        for name, stage in stages[len(done["stages"]) :]:
            current = {k: self._table(v) for k, v in held.items()}
            try:
                changed, numbers = stage(current)
                held = held | {k: self._written(v) for k, v in changed.items()}
            except Exception as error:
                numbers = {"error": f"{type(error).__name__}: {error}"[:300]}
            done = {"stages": [*done["stages"], name], "stats": done["stats"] | {name: numbers}, "tables": held}
            self.commits.add(done)
        return {k: self._table(v) for k, v in held.items()}, done["stats"]
