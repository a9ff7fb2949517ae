"""SimHash near-dedup against all pairs."""

import random

import numpy as np
import xxhash

from evidex.llm import simhash


def plain(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(lower).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints, radius):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    nodes = list(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in nodes}


def test_near_dedup(docs_of, awkward):
    prints = [(i, plain(t)) for i, t in awkward]
    root = classes({p for _, p in prints}, 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = [(i, p - (p >> 63 << 64), least[root[p]]) for i, p in prints]
    got = [tuple(r) for r in simhash.near_dedup(docs_of(awkward)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(25)}
    table = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fingerprint long")
    want = classes(prints, 4)
    for held in (1 << 21, 3000):
        monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", held)
        links = simhash.near_links(table, 4, prefix_bits=6)
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in links.collect():
            a, b = find(a % (1 << 64)), find(b % (1 << 64))
            root[max(a, b)] = min(a, b)
        assert {p: find(p) for p in prints} == want


def test_components_follow_long_paths(spark):
    from evidex.llm.scratch import Scratch

    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000, 1002: 1000}


def test_no_documents(docs_of):
    assert simhash.near_dedup(docs_of([])).collect() == []


def test_majority_needs_over_half():
    hashes = np.array([0b11, 0b01], np.uint64)
    assert simhash.fingerprints(hashes, np.array([2, 0])).tolist() == [0b01, 0]
