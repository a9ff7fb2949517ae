"""Substring search by posting lists against reading every text."""

import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import gram_index, search


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    words = ["alpha", "Beta", "漢字", "é", "x", "License", "ICENS", "a" * 30, "\U0001f600", "tab\tbed", "line\nbreak", "%_"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(12))), rnd.choice(["", None, "the title", "Beta"])) for i in range(300)]
    return [*rows, (300, None, None), (301, "zq", None), (302, "end", "startzq"), (None, "no key zq", "")]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    made = gram_index.GramIndex(spark, str(tmp_path_factory.mktemp("grams")))
    made.build(spark.createDataFrame(texts, "id long, body string, title string").repartition(5), "id", ["title", "body"])
    return made


@pytest.mark.parametrize("query", ["license", "LICENSE", "zq", "é", "漢字 ", "aaaa", "a" * 31, "\U0001f600\U0001f600", "b\tb", "e\nb", "%_", "x x", "nowhere", "dstart", "\U0001f600 x"])
def test_search(index, texts, query):
    if len(query) < 2:
        with pytest.raises(ValueError):
            index.search(query)
        return
    want = sorted((i for i, b, t in texts if query.lower() in (b or "").lower() or query.lower() in (t or "").lower()), key=str)
    assert sorted((r.key for r in index.search(query).collect()), key=str) == want


def test_lists_are_short_and_few(index, spark):
    whole = spark.read.parquet(f"{index.folder}/lists")
    assert whole.select("bucket").distinct().count() > 10
    read = index.lists("license")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in read.replace("isnotnull(bucket#", "bucket#") or "bucket" in read.split("PartitionFilters")[1][:200]
    assert index.candidates("license").count() < 304
    assert whole.agg(F.max(F.array_max("gaps"))).first()[0] < gram_index.RANGE


def test_ranges_are_met_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gram_index, "RANGE", 7)
    made = gram_index.GramIndex(spark, str(tmp_path / "g"))
    made.build(spark.range(40).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("t")), "id", ["t"])
    assert sorted(r.key for r in made.search("w 3").collect()) == [3, *range(30, 40)]
    assert made.search("row").count() == 40


def test_hybrid_search_is_the_same(spark, index, texts):
    rows = spark.createDataFrame([(i, b, t) for i, b, t in texts if i is not None], "id long, body string, title string")
    vectors = rows.where("id % 2 = 0").select("id", F.array(F.cos("id"), F.sin("id")).alias("v"))
    want = search.hybrid_search(rows.join(vectors, "id", "left"), "id", ["title", "body"], "v", "license", [1.0, 0.0], 0.9, 300)
    got = gram_index.hybrid_search(index, "id", vectors, "v", "license", [1.0, 0.0], 0.9, 300)
    assert got.collect() == want.collect()
