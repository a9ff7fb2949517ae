"""Batches held against the index of earlier ones give what one run gives, and read only the buckets that they meet."""

import pytest
from pyspark.sql import functions as F
from test_operators import RAW, START, greedy, random_items

from evidex.config import EngineConfig
from evidex.operators import dedup
from evidex.operators.comparators import ComparatorIndex, against_history


@pytest.mark.parametrize("shared", [1, 2])
def test_batches_against_an_index(spark, tmp_path, shared):
    rows = random_items(90, 7)
    config = EngineConfig(ai_terms=("alpha", "omega"), industry_terms=("a",))
    keep = lambda df: df.checkpoint()
    ready = keep(dedup.prepare(spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], RAW), config, F.lit(START)))
    index, got = ComparatorIndex(spark, str(tmp_path / "index"), 3, 8, shared), {}
    for batch, (low, high) in enumerate([(0, 40), (40, 41), (41, 90)]):
        part = ready.where(F.col("seq").between(low, high - 1))
        for _ in range(2):  # a batch that runs again sees what it saw
            decided = keep(dedup.layered_dedup(part, index.before(batch), 3, keep))
            index.add(part.join(decided.where("reason is null"), "seq", "left_semi"), batch)
        got |= {r.seq: (r.reason, r.dup_of) for r in decided.collect()}
    want = greedy(spark, rows, [], ("alpha", "omega"))
    assert {i: r for i, (r, _) in got.items()} == dict(enumerate(want))
    assert all(d is None or d < i and got[d][0] is None for i, (_, d) in got.items())


def test_history_is_not_met_with_itself(spark, tmp_path):
    index = ComparatorIndex(spark, str(tmp_path / "index"), 3, 16)
    schema = "seq long, url_canonical string, title_norm string, simhash long"
    index.add(spark.createDataFrame([(i, f"u{i}", f"t{i}", i * 0x9E3779B97F4A7C15 % (1 << 62)) for i in range(400)], schema), 0)
    asked = spark.createDataFrame([(1000, "u7", "new", None), (1001, "v", "", 9 * 0x9E3779B97F4A7C15 % (1 << 62) ^ 5), (1002, None, "t8", None)], schema)
    met = against_history(asked, index.before(1, -5000), 3)
    found = {r.seq: (r.url_canonical_stood, r.title_norm_stood, r.simhash_stood) for r in met.collect()}
    assert found == {1000: (7 - 5000, None, None), 1001: (None, None, 9 - 5000), 1002: (None, 8 - 5000, None)}
    plan = met._jdf.queryExecution().toString()
    read = [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters" in line and "bucket" in line]
    assert read and all("kind" in line.split("PartitionFilters")[1] for line in read)
    nothing = asked.select(F.lit("url").alias("kind"), F.lit("no").alias("key")).limit(0)
    assert index.told(nothing).count() == 0


def test_no_history(spark, tmp_path):
    index = ComparatorIndex(spark, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "u", "t", 5)], "seq long, url_canonical string, title_norm string, simhash long")
    assert [tuple(r) for r in against_history(asked, index, 3).collect()] == [(1, "u", "t", 5, None, None, None)]
