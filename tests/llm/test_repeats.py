"""Removal of repeated passages against a dictionary of all windows."""

import random

import numpy as np
import pytest
import xxhash

from evidex.llm import repeats


def brute(rows, length):
    # Rows without a doc_id stand before all others, by the hash of their text.
    order = lambda i, data: (xxhash.xxh64_intdigest(data, 42) >> 3) - (1 << 63) if i is None else i
    least = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            least[w] = min(order(i, data), least.get(w, order(i, data)))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if least[data[k : k + length]] < order(i, data):
                gone[k : k + length] = True
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def check(docs_of, rows):
    got = [(*tuple(r)[:4], bytes(r.kept)) for r in repeats.remove_repeats(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 50), key=str)


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_awkward_documents(docs_of, awkward, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    check(docs_of, awkward)


@pytest.mark.parametrize("crowded", [400, 1])
def test_crowded_anchors_part(docs_of, monkeypatch, crowded):
    """One phrase in many surroundings: its anchor parts until windows stand alone; rows without ids hold it too."""
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    phrase = "a phrase that stands in every document"
    rows = [(i if i % 5 else None, text(9) + text(rnd.randint(1, 9)) + phrase + text(rnd.randint(1, 9)) + text(9)) for i in range(80)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(300 + i, t[3:-4]) for i, (_, t) in enumerate(rows[20:50])]
    check(docs_of, rows)


def test_statistics_by_steps_over_runs():
    """Stepping left over the runs finds the windows that a smaller document holds."""
    rnd = np.random.default_rng(2)
    texts = [rnd.integers(97, 99, rnd.integers(8, 30), np.uint8) for _ in range(60)]
    docs, sizes = rnd.integers(0, 9, 60), np.array([len(t) for t in texts])
    first, n = np.cumsum(sizes) - sizes, sizes - 7
    nth = np.concatenate([np.arange(k) for k in n])
    data = np.concatenate(texts)
    index = repeats.RunIndex(data, np.repeat(first, n) + nth, nth == 0, np.repeat(docs, n), 8)
    holders = {}
    for t, d in zip(texts, docs.tolist()):
        for k in range(len(t) - 7):
            holders.setdefault(t[k : k + 8].tobytes(), set()).add(d)
    want = [sum(1 << k for k in range(len(t) - 7) if min(holders[t[k : k + 8].tobytes()]) < d) for t, d in zip(texts, docs.tolist())]
    assert index.held_before(data, first, n, docs).tolist() == want
    assert len(index.runs) < n.sum()


def test_passages_in_other_contexts(docs_of):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcd é") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 80, 300)]
    rows = [(i, text(rnd.randint(0, 90)) + rnd.choice(passages) + text(rnd.randint(0, 40)) + rnd.choice(passages)) for i in range(60)]
    rows += [(100, passages[5][:120] + passages[5][100:]), (101, None), (102, "a" * 200), (103, "b" + "a" * 120)]
    check(docs_of, rows)


def test_no_documents(docs_of):
    assert repeats.remove_repeats(docs_of([])).collect() == []


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(1)
    passage = rnd.integers(97, 101, 90, np.uint8)
    for _ in range(20):
        text = np.concatenate([rnd.integers(97, 101, rnd.integers(0, 60), np.uint8), passage, rnd.integers(97, 101, 30, np.uint8)])
        first, n, gram = repeats.anchors(text)
        assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(text) - 49
    assert repeats.anchors(passage[:49])[0].size == 0


def test_blocks_are_those_of_spark(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 63), (1 << 63) - 1, 123456789]
    frame = spark.createDataFrame([(i,) for i in ids], "d long").selectExpr("d", "pmod(hash(d), 37) b")
    want = {r.d: r.b for r in frame.collect()}
    assert dict(zip(ids, repeats.block_of(np.array(ids, np.int64), 37).tolist())) == want


def test_copies_with_changes(docs_of):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[: 100 * i] + "#" + base[100 * i + 1 :] + str(i)) for i in range(20)] + [(50 + i, base) for i in range(5)]
    rnd.shuffle(rows)
    check(docs_of, rows)
