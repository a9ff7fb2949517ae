"""Ten thousand patterns in one pass against looking for each."""

import random

from pyspark.sql import functions as F

from evidex.functions import patterns


def test_ten_thousand_patterns(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé漢 ") for _ in range(rnd.randint(1, 6)))
    known = sorted({word() for _ in range(14_000)})[:10_000]
    texts = [(i, "".join(rnd.choice("abcé漢 \U0001f600") for _ in range(rnd.randrange(80)))) for i in range(60)] + [(60, None), (61, "")]
    frame = spark.createDataFrame(texts, "id long, t string").repartition(3)
    given = spark.createDataFrame([(p,) for p in [*known, known[0], "", None]], "pattern string")
    want = {(i, p) for i, t in texts if t for p in known if p in t}
    for most in (1 << 20, 9_000):
        got = patterns.pattern_hits(frame, "id", "t", given, most_chars=most).collect()
        assert {(r.id, r.pattern) for r in got} == want and len(got) == len(want)


def test_no_patterns(spark):
    frame = spark.createDataFrame([(1, "a")], "id long, t string")
    assert patterns.pattern_hits(frame, "id", "t", spark.createDataFrame([], "pattern string")).count() == 0
    plan = patterns.pattern_hits(frame, "id", "t", spark.createDataFrame([("a",), ("b",)], "pattern string")).where(F.col("id") > 0)._jdf.queryExecution().toString()
    assert "Join" not in plan
