"""Judges answer questions about batches of rows; the engine never depends on which one it has."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .answers import AnswerLog


class Judge(Protocol):
    """Answers one batch: a list of dicts in, a JSON text out."""

    def answer(self, task: str, rows: list[dict]) -> str: ...


class ScriptedJudge:
    """Answers from a list, in turn; keeps the questions."""

    def __init__(self, answers: list[object]):
        self.answers, self.asked = list(answers), []

    def answer(self, task: str, rows: list[dict]) -> str:
        self.asked.append((task, rows))
        return json.dumps(self.answers[min(len(self.asked), len(self.answers)) - 1])


class RuleJudge:
    """Answers by a function of a row; picklable if the function is."""

    def __init__(self, rule: Callable[[dict], object]):
        self.rule = rule

    def answer(self, task: str, rows: list[dict]) -> str:
        return json.dumps([self.rule(r) for r in rows])


def cache_key(model: str, task: str, rows: list[dict], temperature: float = 0.0) -> str:
    return hashlib.sha1(json.dumps([model, task, rows, temperature], sort_keys=True, default=str).encode()).hexdigest()


class CachedJudge:
    """Replays known answers; asks ``inner`` for the others, or fails without one."""

    def __init__(self, known: dict[str, str], inner: Judge | None = None, model: str = "judge"):
        self.known, self.inner, self.model, self.fresh = known, inner, model, {}

    def answer(self, task: str, rows: list[dict]) -> str:
        key = cache_key(self.model, task, rows)
        if key not in self.known:
            if self.inner is None:
                raise KeyError(f"no replayed answer for {task}")
            self.known[key] = self.fresh[key] = self.inner.answer(task, rows)
        return self.known[key]


def with_retries(judge: Judge, tries: int = 3, wait: Callable[[int], None] = lambda n: None) -> Judge:
    """A judge that is asked again after an error."""

    class Retried:
        def answer(self, task: str, rows: list[dict]) -> str:
            for n in range(tries):
                try:
                    return judge.answer(task, rows)
                except Exception:
                    if n == tries - 1:
                        raise
                    wait(n)
            raise AssertionError

    return Retried()


def batches(rows: DataFrame, size: int, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with batch (from 0) and i (place in the batch), in a total order, inside groups if given."""
    placed = numbered(rows, order, within, "_place")
    return placed.select(*rows.columns, F.floor(F.col("_place") / size).cast("long").alias("batch"), (F.col("_place") % size).cast("int").alias("i"))


def ask(rows: DataFrame, judge: Judge, task: str, keys: list[str], size: int, log: AnswerLog | None = None) -> DataFrame:
    """(keys, answer): what ``log`` doesn't hold is put to the judge in batches of ``size``, once, before this returns.

    The frame reads the log, so reading it again asks nothing; answer is null where the judge failed.
    """
    return (log or AnswerLog(rows.sparkSession)).ask(rows, judge, task, keys, size)


def token_cost(tokens_in, tokens_out):
    """Price of a call from its token counts."""
    return F.bround(tokens_in / 1e6 * 2 + tokens_out / 1e6 * 3, 4)


def cache_entries(lines: DataFrame) -> DataFrame:
    """(key, value) of a log of JSON lines (n, line): lines that don't parse or lack a key are skipped, the last of a key stays."""
    entry = F.from_json("line", "key string, value string")
    return latest_cache(lines.select("n", entry.alias("e")).select("n", "e.key", "e.value"), "key", "value", "n")


def latest_cache(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value written for each key; broken values are skipped."""
    good = log.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return good.groupBy(key).agg(F.max_by(value, order).alias(value))
