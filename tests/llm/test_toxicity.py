"""Toxicity: held-out accuracy on the given tables, and the defined cases."""

import math
import zlib

import pytest

from evidex.llm import toxicity as module
from evidex.llm.toxicity import score, toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    ones = [r for r in got if r.toxic == 1]
    found = sum(r.predicted for r in ones)
    wrong = sum(r.predicted for r in got if r.toxic == 0)
    # About 3 000 rows to learn from, with rare words in four languages; four times as many find over 0.95.
    assert found >= 0.8 * len(ones) and wrong <= 0.01 * len(got)


def test_awkward_rows_get_a_score(spark, docs_of, awkward):
    labels = spark.createDataFrame([(7 * k, 1, k % 2) for k in range(20)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs_of(awkward), labels).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_nothing_to_learn_from(spark, docs_of, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity(docs_of(awkward), none).collect()} == {0}
    assert toxicity(docs_of([]), none).collect() == []


def test_learner_against_its_formulas(monkeypatch):
    """FTRL-proximal by the published update, one coordinate at a time, in plain Python."""
    monkeypatch.setattr(module, "L1", 0.4)
    rows = [(f"word{i % 7} bad{i % 3} shared text {'nasty' if i % 3 == 0 else 'nice'} w{i}", int(i % 3 == 0)) for i in range(60)] * 2
    model, z, n = module.Ftrl(1 << module.BITS), {}, {}

    def weight(k):
        if k not in z or (k != "bias" and abs(z[k]) <= 0.4):
            return 0.0
        rate = (module.BETA + math.sqrt(n[k])) / module.ALPHA
        return -z[k] / rate if k == "bias" else -(z[k] - math.copysign(0.4, z[k])) / (rate + module.L2)

    for text, label in rows:
        model.learn(module.features(text), label)
        features = [*module.features(text).tolist(), "bias"]
        old = {k: weight(k) for k in features}
        gap = 1 / (1 + math.exp(-sum(old.values()))) - label
        gap *= module.ONES_WEIGHT if label else 1
        for k in features:
            before = n.get(k, 0.0)
            n[k] = before + gap * gap
            z[k] = z.get(k, 0.0) + gap - (math.sqrt(n[k]) - math.sqrt(before)) / module.ALPHA * old[k]
    weights = model.weights(slice(0, -1))
    want = {k: w for k in z if k != "bias" and (w := weight(k))}
    assert {int(k): float(weights[k]) for k in weights.nonzero()[0]} == pytest.approx(want) and model.bias() == pytest.approx(weight("bias"))
    assert 0 < len(want) < len(z)


def test_a_column_of_the_scores_name_is_replaced(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, "c d")]).selectExpr("*", "9D as toxicity_score", "'x' as label", "1 as at")
    got = score(docs, labels)
    assert got.columns.count("toxicity_score") == 1 and all(r.toxicity_score < 9 and r.label == "x" for r in got.collect())
