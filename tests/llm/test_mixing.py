"""Mixing against plain Python: sizes, targets by rounds, epochs and the weighted order."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from evidex.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, place int, weight double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "clash", 3, 4.0) for i, t, s in rows], SCHEMA).repartition(3)


def expected(rows, quality):
    """(doc_id, source, size, source_size, target, taken), sorted."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t or "") for i, t, s in rows]
    total = defaultdict(int)
    for _, s, n, _ in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        open_ = [s for s in names if s not in full]
        rate = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if weight[s] * rate > 2 * total[s]}
        if not above:
            break
        full |= above
    target = {s: 2.0 * total[s] if s in full else weight[s] * rate for s in names}
    drawn = []
    for i, s, n, t in sized:
        parts = ["mix", *([str(i)] if i is not None else []), t]
        u = (int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        drawn.append((-math.log(u) / quality.get(i, 1.0), -1 if i is None else i, n, s, i))
    out, before = [], defaultdict(int)
    for _, _, n, s, i in sorted(drawn, key=lambda d: d[:3]):
        asked = math.floor(target[s] + 0.5)
        epochs = asked // total[s] if total[s] else 0
        out.append((i, s, n, total[s], target[s], epochs * n + max(0, min(n, asked - epochs * total[s] - before[s]))))
        before[s] += n
    return sorted(out, key=str)


def mixed(spark, rows, quality):
    weights = spark.createDataFrame(list(quality.items()) or [(-5, 1.0)], "doc_id long, weight double")
    return sorted(((r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(table(spark, rows), weights).collect()), key=str)


def test_mix(spark, awkward):
    sources = ["b", None, "a", "é", "", "hot", "hot", "hot", "hot"]
    rows = [(i, t, sources[k % len(sources)]) for k, (i, t) in enumerate(awkward)] + [(901, "", "empty"), (902, None, "empty"), (903, "w " * 100_000, "long")]
    quality = {i: (0.5, 2.0)[k % 2] for k, (i, _) in enumerate(awkward) if i is not None and k % 3}
    got, want = mixed(spark, rows, quality), expected(rows, quality)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4] == pytest.approx(w[4]) for g, w in zip(got, want))
    taken, target = defaultdict(int), {}
    for g, w in zip(got, want):
        assert g[5] <= 2 * g[2]
        taken[g[1]] += g[5]
        target[g[1]] = g[4]
    assert [g[5] for g in got] == [w[5] for w in want]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken) and len(target) == 8
    assert mixed(spark, rows, quality) == got


def test_a_source_may_be_the_only_one_or_none(spark):
    assert mixed(spark, [], {}) == []
    assert mixed(spark, [(1, "a b c", None)], {}) == [(1, None, 3, 3, 4.5, 5)]
    assert mixed(spark, [(1, None, "a"), (2, " ", "b")], {}) == [(1, "a", 0, 0, 0.0, 0), (2, "b", 0, 0, 0.0, 0)]


def test_better_documents_come_earlier(spark):
    rows = [(i, f"w{i} " * 5, "s") for i in range(4000)]
    good = {i: 4.0 for i in range(0, 4000, 2)}
    got = mixing.mix(table(spark, rows), spark.createDataFrame(list(good.items()), "doc_id long, weight double")).orderBy("key").limit(1000).collect()
    # Of weights 4 and 1 the first thousand of four thousand draws are 77.6 % good ones.
    assert abs(sum(r.doc_id % 2 == 0 for r in got) - 776) < 40


def test_odd_weights_count_as_one(spark):
    rows = [(i, f"a b {i}", "s") for i in range(6)]
    odd = {0: float("nan"), 1: 0.0, 2: -1.0, 3: 1.0}
    assert mixed(spark, rows, odd) == mixed(spark, rows, {})


def test_label_weights(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.weight for r in mixing.label_weights(labels).collect()} == {1: 2.0, 2: 0.5, 3: 1.0}
