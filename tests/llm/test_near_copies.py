"""The near-copy stage against all pairs by five-word Jaccard similarity."""

import random

import corpus_pipeline
from evidex.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies_stage(spark, table(spark, rows), "").collect()), key=str)


def least_of_components(rows):
    """Ids of the first row of each component of pairs with a similarity of 0.8 or more."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def planted():
    """Texts of 60, 200 and 800 words, each with copies whose similarity runs from under 0.8 to 1."""
    rnd, rows = random.Random(8), []
    for words, most in ((60, 3), (200, 6), (800, 20)):
        for _ in range(12):
            base = [f"w{rnd.randrange(4000)}" for _ in range(words)]
            rows.append((len(rows), " ".join(base)))
            for n in {1, most // 2, most}:
                copy = list(base)
                for at in rnd.sample(range(words), n):
                    copy[at] = f"new{rnd.randrange(10**6)}"
                rows.append((len(rows), " ".join(copy)))
    return rows


def test_planted_near_copies_go(spark):
    rows = planted()
    want = least_of_components(rows)
    assert 40 < len(want) < len(rows) - 40
    assert {i for i, _ in kept(spark, rows)} == want


def test_unlike_texts_under_one_key_are_compared_with_each_other(spark, monkeypatch):
    rows = planted()[:48]
    monkeypatch.setattr(near_copies, "band_keys", lambda sets: near_copies.np.tile(near_copies.np.arange(near_copies.BANDS, dtype="u8"), (len(sets), 1)))
    assert {i for i, _ in near_copies.near_copies(table(spark, rows[:1])).collect()} == set()
    met = near_copies.near_copies(table(spark, rows)).count()
    assert met == len(rows) - len(least_of_components(rows))


def test_rows_are_dropped_by_id_and_text(spark):
    rnd = random.Random(3)
    text = lambda: [f"w{rnd.randrange(4000)}" for _ in range(100)]
    base, other, third = text(), text(), text()
    near = lambda t: " ".join([*t[:-1], "new"])
    rows = [(1, " ".join(base)), (5, near(base)), (5, " ".join(other))]
    assert kept(spark, rows) == sorted([rows[0], rows[2]], key=str)
    without = [(None, " ".join(third)), (None, near(third)), (None, " ".join(other)), (7, near(base)), (None, " ".join(base))]
    left = kept(spark, without)
    assert len(left) == 3 and (None, " ".join(other)) in left and (7, near(base)) in left
    assert kept(spark, [(1, ""), (2, None), (3, " "), (4, "a")]) == [(1, ""), (4, "a")]
