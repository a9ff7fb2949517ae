"""Each question is asked once, whoever reads the answer and whatever fails."""

import json
import os
import sys
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidex.config import EngineConfig
from evidex.operators import screening, stages
from evidex.plugins import answers
from evidex.plugins.answers import AnswerLog
from evidex.plugins.judge import ask
from evidex.schemas import TABLES

# Workers can't import tests, so the judge goes to them as it is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Writes down each batch that it is asked, as one file; answers by a rule; may die before or after one of them."""

    def __init__(self, folder, rule, dies_at=None, says=True):
        self.folder, self.rule, self.dies_at, self.says = str(folder), rule, dies_at, says
        os.makedirs(self.folder, exist_ok=True)

    def answer(self, task, rows):
        if self.dies_at and any(self.dies_at in json.dumps(r) for r in rows) and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        with open(f"{self.folder}/{uuid.uuid4().hex}.json", "w") as out:
            json.dump([task, rows], out)
        if not self.says:
            raise OSError("no answer")
        return json.dumps([self.rule(r) for r in rows])

    def batches(self):
        for name in os.listdir(self.folder):
            if name.endswith(".json"):
                with open(f"{self.folder}/{name}") as given:
                    yield json.load(given)

    def asked(self):
        return Counter(json.dumps([task, row], sort_keys=True) for task, rows in self.batches() for row in rows)


@pytest.fixture
def log(spark, tmp_path):
    return AnswerLog(spark, str(tmp_path / "log"))


def numbers(spark, n, parts):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") * 7 % 5).alias("v")).repartition(parts)


def test_batches_do_not_follow_partitions(spark, tmp_path):
    seen = []
    for parts in (1, 40):
        judge = Counting(tmp_path / f"j{parts}", lambda r: {"x": r["v"]})
        got = ask(numbers(spark, 50, parts), judge, "t", ["id"], 12)
        assert {(r.id, json.loads(r.answer)["x"]) for r in got.collect()} == {(str(i), i * 7 % 5) for i in range(50)}
        seen.append(sorted(tuple(r["id"] for r in rows) for _, rows in judge.batches()))
    assert seen[0] == seen[1] and sorted(map(len, seen[0])) == [2, 12, 12, 12, 12]


def test_only_what_is_new_is_asked(spark, tmp_path, log):
    judge = Counting(tmp_path / "j", lambda r: {"x": r["v"]})
    for n in (30, 30, 50):
        got = ask(numbers(spark, n, 3), judge, "t", ["id"], 4, log)
        assert got.count() == n and got.where("answer is null").count() == 0
    assert set(judge.asked().values()) == {1} and len(judge.asked()) == 50
    ask(numbers(spark, 5, 2), judge, "another task", ["id"], 4, log)
    assert len(judge.asked()) == 55
    assert log.read().groupBy("task").count().orderBy("task").collect() == [("another task", 5), ("t", 50)]


def test_answers_survive_a_task_that_dies(spark, tmp_path, log):
    judge = Counting(tmp_path / "j", lambda r: {"x": r["v"]}, dies_at='"id": "33"')
    rows = numbers(spark, 60, 1)
    with pytest.raises(Exception, match="(?i)worker|crash|abort"):
        ask(rows, judge, "t", ["id"], 5, log)
    before = len(judge.asked())
    got = ask(rows.unionByName(numbers(spark, 3, 1).withColumn("id", F.concat(F.lit("new"), "id"))), judge, "t", ["id"], 5, log)
    assert {(r.id, r.answer) for r in got.collect() if r.answer is None} == set()
    assert before and set(judge.asked().values()) == {1} and len(judge.asked()) == 63


def test_errors_are_not_answers(spark, tmp_path, log):
    silent = Counting(tmp_path / "a", lambda r: r, says=False)
    got = ask(numbers(spark, 9, 2), silent, "t", ["id"], 4, log)
    assert got.where("answer is null").count() == got.count() == 9 and log.read().count() == 0
    assert ask(numbers(spark, 9, 2), Counting(tmp_path / "b", lambda r: {"x": 1}), "t", ["id"], 4, log).where("answer is null").count() == 0


def test_stages_read_the_log(spark, tmp_path, log):
    """S1b, S3 and S6b: every consumer of a stage's tables is run, and the whole stage again."""
    judge = Counting(tmp_path / "j", lambda r: {"dup": r.get("title_a") == r.get("title_b"), "keep": True, "relation": "follows", "from": "A", "basis": "a basis that is long enough"})
    at = F.lit("2026-01-10").cast("timestamp_ntz")
    n = F.col("id").cast("int")
    items = spark.range(24).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), (n % 2).cast("string")).alias("title"), F.lit("c").alias("content"), F.lit("u").alias("url"),
        F.lit("pending").alias("status"), at.alias("published_at"), (at + F.make_dt_interval(F.lit(0), F.lit(0), n)).alias("discovered_at"),
    )
    vectors = items.select("id", F.array(F.cos(n * 0.02), F.sin(n * 0.02)).alias("vector"))
    config = EngineConfig(relate_low=0.5, relate_high=0.99, relate_focus=0)
    events = items.select("id", F.lit("co").alias("company"), "title", F.lit("2026-01-01").cast("date").alias("event_date"), at.alias("last_update_at"))
    none = lambda t: spark.createDataFrame([], TABLES[t])
    claims = spark.createDataFrame([], "id string, event_id string, kind string, text string")
    counts = []
    for _ in range(2):
        found = stages.semantic_dedup(items, vectors, judge, config, at, "R", at, log=log)
        counts += [found["items"].count(), found["rejects"].count()]
        screened = screening.prescreen(items, judge, log=log)
        counts += [screened.count(), screened.where("status = 'screened'").count()]
        told = stages.relate(events, claims, none("edges"), none("reviews"), vectors, judge, config, at, at, log=log)
        counts += [told["edges"].count(), told["reviews"].count()]
    assert counts[:6] == counts[6:] and counts[0] == 24 and counts[1] > 0 and counts[4] > 0
    assert set(judge.asked().values()) == {1} and {json.loads(q)[0] for q in judge.asked()} == {"syndication", "prescreen", "relate"}


def test_journals_files_do_not_follow_batches(spark, tmp_path, log, monkeypatch):
    files, take_in = [], AnswerLog._take_in

    def counted(self, journal):
        files.append(sum(name.endswith(".json") for _, _, names in os.walk(journal) for name in names))
        take_in(self, journal)

    monkeypatch.setattr(AnswerLog, "_take_in", counted)
    got = ask(numbers(spark, 300, 3), Counting(tmp_path / "j", lambda r: {"x": r["v"]}), "t", ["id"], 1, log)
    assert got.where("answer is null").count() == 0 and log.read().count() == 300 and 0 < files[0] <= 8


def test_attempts_know_what_others_wrote(tmp_path, monkeypatch):
    monkeypatch.setattr(answers, "JOIN_BATCHES", 3)
    folder = str(tmp_path / "0")
    one, two = answers.Journal(folder), answers.Journal(folder)
    for n in range(7):
        one.add([json.dumps({"key": f"k{n}"}), json.dumps({"batch": f"b{n}"})])
    assert two.batches() == {f"b{n}" for n in range(7)} and len(os.listdir(folder)) == 3
    two.add([json.dumps({"batch": "c"})])
    one.join()
    two.join()
    assert answers.Journal(folder).batches() == two.batches() and "c" in two.batches()
    lines = [x for name in os.listdir(folder) for x in (tmp_path / "0" / name).read_text().splitlines()]
    assert sorted(lines) == sorted(set(lines)) and len(lines) == 15
