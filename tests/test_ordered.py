"""Order-aware columns over range partitions against plain Python and against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    """Nine rows in ten belong to one group, one group is null, places repeat."""
    rnd = random.Random(4)
    data = [(rnd.choice(["hot"] * 18 + ["cold", None]), rnd.choice([None, *range(40)]), n, rnd.randrange(9)) for n in range(600)]
    return spark.createDataFrame(data, "g string, day int, id int, v int").repartition(7).cache()


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay as they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def by(rows, **names):
    return {r.id: r for r in rows.collect()}


def test_numbers_sums_and_rows_before(spark, rows, uncoalesced):
    window = Window.partitionBy("g").orderBy("day", "id")
    want = by(rows.select("*", (F.row_number().over(window) - 1).alias("place"), F.count("*").over(Window.partitionBy("g")).alias("n"),
                          F.coalesce(F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("id").over(window).alias("last")))
    numbers = ordered.numbered(rows, ["day", "id"], ["g"], total="n")
    assert numbers.count() == 600 and all((r.place, r.n) == (want[r.id].place, want[r.id].n) for r in numbers.collect())
    assert all(r.before == want[r.id].before for r in ordered.running_sum(rows, "v", ["day", "id"], ["g"]).collect())
    previous = ordered.row_before(rows, ["day", "id"], ["g"], ["id", "v"]).collect()
    assert len(previous) == 600 and all((r.previous.id if r.previous else None) == want[r.id].last for r in previous)


def test_one_group_fills_many_tasks(spark, rows, uncoalesced):
    dealt = ordered.placed(rows, ["day", "id"], ["g"], ordered.checkpointed)
    assert dealt.where("g = 'hot'").select("_part").distinct().count() > 2
    plan = ordered.numbered(rows, ["day", "id"])._jdf.queryExecution().toString()
    assert "Window [row_number" not in plan
    assert sorted(r.place for r in ordered.numbered(rows, ["day", "id"]).collect()) == list(range(600))


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, rows, strict, uncoalesced):
    given = rows.where("id % 5 = 0").select("g", "day", F.col("id").alias("seen"))
    got = by(ordered.as_of(rows.select("g", "day", "id"), given, "day", ["g"], ["seen"], strict=strict))
    told = [(r.g, r.day, r.seen) for r in given.collect() if r.day is not None]
    assert len(got) == 600
    for r in got.values():
        fits = [(day, seen) for g, day, seen in told if g == r.g and r.day is not None and (day < r.day if strict else day <= r.day)]
        assert (r.asof.seen if r.asof else None) == (max(fits)[1] if fits else None)


def test_no_rows(spark, rows):
    none = rows.where("false")
    assert ordered.numbered(none, ["id"], ["g"]).count() == ordered.running_sum(none, "v", ["id"]).count() == ordered.row_before(none, ["id"], ["g"], ["v"]).count() == 0
    assert ordered.as_of(rows, none.select("g", "day", "v"), "day", ["g"], ["v"]).where("asof is not null").count() == 0
