"""The threshold algorithm against scoring every row, and how many postings it reads."""

import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import brief_index, search


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    rare, common = [f"rare{chr(97 + i)}" for i in range(6)], ["the", "and", "of", "model", "新闻", "模型"]
    data = []
    for i in range(600):
        words = [w for w in common if rnd.random() < 0.7] + [w for w in rare if rnd.random() < (0.4 if i % 50 == 0 else 0.01)]
        data.append((i, " ".join(words), rnd.choice([None, -0.5, 0.0, 0.1, 0.4]) if i % 7 else rnd.random(), rnd.choice(["new", "continuing", "old"])))
    return spark.createDataFrame([*data, (600, None, None, "old"), (601, "", 0.9, "new")], "id long, t string, sim double, status string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    made = brief_index.BriefIndex(spark, str(tmp_path_factory.mktemp("briefs")))
    made.build(rows, "id", "t")
    return made


PROMPTS = ["rarea rareb rarec rared raree raref the and of model 新闻模型", "the and of", "rarea", "nothing matches", "", "新闻"]


@pytest.mark.parametrize("prompt", PROMPTS)
@pytest.mark.parametrize("top", [1, 15])
def test_top_is_exact(index, rows, prompt, top):
    static = 6 * F.coalesce("sim", F.lit(0.0)) + F.when(F.col("status") == "new", 2).when(F.col("status") == "continuing", 1).otherwise(0)
    want = search.brief_candidates(rows, "id", "t", prompt, F.col("sim"), F.col("status"), top).collect()
    got = index.top(prompt, rows.select(F.col("id").alias("key"), static.alias("static")), top).collect()
    assert [r.key for r in got] == [r.id for r in want]
    assert all(abs(g.score - w.score) < 1e-9 for g, w in zip(got, want))


def test_common_lists_are_not_read(index, rows):
    none = rows.select(F.col("id").alias("key"), F.lit(0.0).alias("static"))
    index.top("rarea rareb rarec rared raree raref", none, 1)
    whole = index.all
    got = index.top(PROMPTS[0], none, 1)
    assert got.count() == 1 and whole < index.all and 0 < index.read < 0.7 * index.all
