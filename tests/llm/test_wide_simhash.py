"""Wide SimHash fingerprints: bits, bands and what meets, against plain Python and all pairs."""

import random

import numpy as np
import pytest

from evidex.llm import near_copies, simhash
from test_near_copies import jaccard, kept, least_of_components, planted, shingles, table


def bits(print_):
    return "".join(f"{int(w):064b}" for w in print_)


def test_the_first_word_is_op8s_fingerprint_of_the_set():
    rnd = random.Random(2)
    sizes = [0, 1, 2, 254, 255, 256, 600, 0, 3, 90_000, 5]
    sets = [np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64) for n in sizes]
    got = simhash.wide_fingerprints(sets)
    assert got[:, 0].tolist() == simhash.fingerprints(np.concatenate(sets), np.array(sizes)).tolist()
    alone = np.concatenate([simhash.wide_fingerprints([s]) for s in sets])
    assert (got == alone).all() and not got[0].any() and len({*got[3].tolist()}) == simhash.WORDS
    for print_, bands in zip(got, simhash.bands_of(got)):
        assert "".join(f"{b:020b}" for b in bands) == bits(print_)


@pytest.mark.parametrize("most, held", [(4, 1 << 18), (60, 1 << 18), (80, 1 << 18), (80, 300)])
def test_what_is_near_is_near_a_pair_of_each_group(most, held, monkeypatch):
    """All rows in one group for each part: at each variant what is near another has a pair, and all pairs are near."""
    monkeypatch.setattr(simhash, "BANDED_AT_ONCE", held)
    monkeypatch.setattr(simhash, "COMPARED_AT_ONCE", 50)
    rnd = random.Random(most)
    base = [rnd.getrandbits(320) for _ in range(6)]
    wide = [b ^ sum(1 << x for x in rnd.sample(range(320), rnd.randint(0, 50))) for b in base for _ in range(12)]
    prints = np.array([[w >> 64 * k & (1 << 64) - 1 for k in (4, 3, 2, 1, 0)] for w in wide], np.uint64)
    value = simhash.bands_of(prints)[:, 0]
    for k, equal in enumerate(simhash.PARTS_OF_BAND):
        group = (np.int64(k) << 40) | ((value & equal) << 20) | value
        one, two, apart = simhash._within(group, prints, most)
        assert all((wide[a] ^ wide[b]).bit_count() == d <= most for a, b, d in zip(one, two, apart))
        want = set()
        for a in range(len(wide)):
            for b in range(a):
                near = (wide[a] ^ wide[b]).bit_count() <= most
                if near and (value[a] ^ value[b]) & equal == 0 and int(value[a] ^ value[b]).bit_count() <= 2:
                    want |= {a, b}
        assert want == {*one, *two}
        a, b, _ = simhash._partners(one, two, apart)
        assert {*a} == want


def signed(rows):
    sets = [near_copies.shingle_set((t or "").encode()) for _, t in rows]
    return simhash.wide_fingerprints(sets)


def test_planted_copies_meet_by_simhash(spark):
    """Every row that has a near copy meets a row within the bits; texts of other families never meet."""
    rows = planted()
    prints = signed(rows)
    plain = [(i, bands.tolist(), *(w - (w >> 63 << 64) for w in map(int, p))) for (i, _), p, bands in zip(rows, prints, simhash.bands_of(prints))]
    frame = spark.createDataFrame(plain, "node long, bands array<int>, " + ", ".join(f"{c} long" for c in simhash.WORD_COLUMNS)).repartition(3)
    got = [tuple(r) for r in simhash.near_pairs(frame, near_copies.DIFFERING).collect()]
    assert all(a < b and simhash.distance(prints[a : a + 1], prints[b : b + 1])[0] <= near_copies.DIFFERING for a, b in got)
    sets = [shingles(t) for _, t in rows]
    alike = {i for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8 for i in (a, b)}
    assert alike <= {i for pair in got for i in pair} and all(jaccard(sets[a], sets[b]) > 0.3 for a, b in got)


def test_the_stage_proposes_by_simhash_alone(spark, monkeypatch):
    rows = planted()[:24] + [(900, planted()[0][1].upper())]
    assert {i for i, _ in kept(spark, rows)} == least_of_components(rows)
    asked = []
    monkeypatch.setattr(near_copies, "near_pairs", lambda prints, most: asked.append(most) or prints.select("node", "node").toDF("a", "b").limit(0))
    assert {i for i, _ in kept(spark, rows)} == {i for i, _ in rows} - {900} and asked == [near_copies.DIFFERING]


def test_a_crowd_of_copies_is_one_component(spark):
    """Six hundred texts of one family, a few words apart, beside empty and short ones."""
    rnd = random.Random(6)
    base, rows = [f"w{rnd.randrange(500)}" for _ in range(120)], []
    for n in range(600):
        copy = list(base)
        copy[rnd.randrange(120)] = f"new{n}"
        rows.append((n, " ".join(copy)))
    rows += [(1000, ""), (1001, None), (1002, "a b"), (1003, "A\tb"), (1004, "a c")]
    assert [i for i, _ in kept(spark, rows)] == [0, 1000, 1002, 1004]
    assert table(spark, rows).count() == 605
