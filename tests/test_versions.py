"""Versions are whole or not there; a table of deltas is the table that replacing rows gives; a broken run goes on."""

import os
import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import tables
from evidex.operators.versions import Commits, Snapshot, VersionedTable
from evidex.plans.run import Run, run_stages


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_deltas_are_replaced_rows(spark, tmp_path):
    rnd, want = random.Random(3), {}
    table = VersionedTable(spark, str(tmp_path / "t"), "id", "id string, v long, w string")
    assert table.read().count() == 0
    versions = {}
    for n in range(6):
        rows = {f"k{rnd.randrange(40)}": n * 100 + i for i in range(15)}
        number = table.upsert(spark.createDataFrame(list(rows.items()), "id string, v long"))
        want |= {k: (v, None) for k, v in rows.items()}
        if n == 3:
            gone = sorted(want)[:5]
            number = table.delete(spark.createDataFrame([(g,) for g in gone], "id string"))
            want = {k: v for k, v in want.items() if k not in gone}
        if n == 4:
            number = table.compact()
        versions[number] = dict(want)
    for number, held in versions.items():
        assert {r.id: (r.v, r.w) for r in table.read(number).collect()} == held
    assert {r.id: (r.v, r.w) for r in table.read().collect()} == want


def test_a_small_change_writes_little(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id", "id long, t string")
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    table.upsert(rows)
    first = size_of(tmp_path)
    changed = rows.where("id % 100 = 0").withColumn("t", F.lit("new"))
    table.upsert(changed)
    assert size_of(tmp_path) - first < 0.03 * first
    same = tables.replace_rows(rows, changed, "id")
    assert table.read().exceptAll(same).count() == same.exceptAll(table.read()).count() == 0


def test_null_keys_and_extra_columns(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id", "id string, v long")
    table.upsert(spark.createDataFrame([(None, 1, "x"), ("a", 2, "y")], "id string, v long, more string"))
    table.upsert(spark.createDataFrame([(None, 5), ("b", 3), ("b", 4)], "id string, v long"))
    assert {(r.id, r.v) for r in table.read().collect()} == {(None, 5), ("a", 2), ("b", 4)}


def test_snapshots_fall_back(spark, tmp_path):
    shot = Snapshot(spark, str(tmp_path / "s"))
    assert shot.read("events") is None
    one = spark.createDataFrame([(1, None)], "id long, t string")
    assert shot.write({"events": one, "vectors": one}) == {"events": 1, "vectors": 1}
    # An export that has no vectors keeps those of the one before; one that is killed changes nothing.
    shot.write({"events": one.unionByName(one), "vectors": one.limit(0)}, carry=("vectors",))
    assert shot.read("events").count() == 2 and shot.read("vectors").count() == 1 and shot.read("vectors").columns == ["id", "t"]
    broken = one.withColumn("t", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        shot.write({"events": one, "vectors": broken})
    assert shot.read("events").count() == 2
    # A commit that can't be read, or whose files are gone, gives way to the one before.
    with open(tmp_path / "s/commits/000000000003.json", "w") as out:
        out.write("{broken")
    Commits(str(tmp_path / "s")).add({"documents": {"events": {"path": "v-none/events", "schema": one.schema.json()}}})
    assert shot.read("events").count() == 2 and shot.read("nothing") is None


def test_a_broken_run_goes_on(spark, tmp_path):
    ran = []

    def add(name, fails=False, dies=False):
        def stage(given):
            ran.append(name)
            if dies:
                raise KeyboardInterrupt
            if fails:
                raise ValueError("no answer")
            rows = given["items"].unionByName(spark.createDataFrame([(name,)], "id string"))
            return {"items": rows}, {"n": rows.count()}

        return name, stage

    start = {"items": spark.createDataFrame([("start",)], "id string"), "other": spark.createDataFrame([(1,)], "x int")}
    whole = [add("S0"), add("S1", fails=True), add("S2"), add("S3")]
    run = Run(spark, str(tmp_path), "RUN-1")
    with pytest.raises(KeyboardInterrupt):
        run.go(start, [*whole[:2], add("S2", dies=True), whole[3]])
    assert ran == ["S0", "S1", "S2"]
    tables_, stats = Run(spark, str(tmp_path), "RUN-1").go(start, whole)
    assert ran == ["S0", "S1", "S2", "S2", "S3"]
    want, numbers = run_stages(start, whole, lambda df: df.checkpoint())
    assert sorted(r.id for r in tables_["items"].collect()) == sorted(r.id for r in want["items"].collect()) == ["S0", "S2", "S3", "start"]
    assert stats == numbers and "no answer" in stats["S1"]["error"] and tables_["other"].count() == 1
    assert Run(spark, str(tmp_path), "RUN-1").go(start, whole)[1] == stats and len(ran) == 5 + 4
    with pytest.raises(ValueError, match="began with"):
        run.go(start, [add("other")])
