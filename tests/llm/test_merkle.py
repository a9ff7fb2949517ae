"""The manifest against a tree in plain Python, and the traversal against whole levels."""

import binascii
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evidex.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, `group` string, digest string, height int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    out = ""
    for value in row:
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    """(before, after) at each level from the node ``at`` up."""
    out = []
    for nodes in tree[:-1]:
        low = at // 8 * 8
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 8])))
        at //= 8
    return out


def expected(rows):
    by_lang = {}
    for i, t, lang, s, n in rows:
        by_lang.setdefault(lang, []).append((-1 if i is None else i, leaf((i, s, lang, n, t)), (i, t, lang, s, n)))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([x[1] for x in sorted(by_lang[n], key=lambda x: x[:2])]) for n in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, name in enumerate(names):
        for at, (_, own, (i, t, lang, s, n)) in enumerate(sorted(by_lang[name], key=lambda x: x[:2])):
            path = siblings(trees[g], at) + siblings(top, g)
            if i is not None and binascii.crc32(str(i).encode()) % 3 == 0 and t is not None:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            fold = leaf((i, s, lang, n, t))
            for before, after in path:
                fold = h(before + fold + after)
            out.append((i, own, trees[g][-1][0], top[-1][0], h("".join(b + a for b, a in path)), fold))
    return sorted(out, key=str)


def told(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash", "x", 9) for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(docs, merkle.tampered(docs))
    again = merkle.folded(F.col("changed"), F.col("places"), F.col("proof")).alias("again")
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), again).collect()), key=str)


def test_manifest(spark, awkward):
    langs = ["en", "en", "en", "de", None, "é", ""]
    rows = [(i, t, langs[k % len(langs)], None if k % 5 == 0 else f"s{k}", None if k % 4 == 0 else k) for k, (i, t) in enumerate(awkward)]
    rows += [(1, "Only one", "lone", "s", 8), (2, "Text", "en", "s", 4), (2, "Text", "en", "s", 4), (3, "Long Word " * 20_000, "de", "s", 1), (None, "No Id", "en", None, None)]
    rows += [(10_000 + i, f"Doc {i}", "many", "s", i) for i in range(700)]
    assert told(spark, rows) == expected(rows)


def test_few_rows(spark):
    assert told(spark, []) == []
    for n in (1, 2, 8, 9, 65):
        rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
        assert told(spark, rows) == expected(rows)
    many = [(i, f"T{i}", f"l{i % 70}", "s", i) for i in range(140)]
    assert told(spark, many) == expected(many)


def test_more_leaves_than_a_block(spark, monkeypatch):
    rows = [(i, f"T{i}", "en" if i % 9 else "de", "s", i) for i in range(1300)]
    for height in (1, 2, 3):
        monkeypatch.setattr(merkle, "HEIGHT", height)
        assert told(spark, rows) == expected(rows)


@pytest.mark.parametrize("subtree", [1, 2, 3])
def test_traversal_holds_two_subtrees_a_level(monkeypatch, subtree):
    monkeypatch.setattr(merkle, "SUBTREE", subtree)
    rnd = random.Random(1)
    for n in (1, 7, 8, 9, 64, 65, 500, 513, 4096):
        leaves = [h(str(rnd.random())) for _ in range(n)]
        tree = levels(leaves)
        for at, path in enumerate(merkle.traverse(leaves, len(tree) - 1)):
            want = siblings(tree, at)
            assert [(r[: p * 64], r[p * 64 + 64 :]) for p, r in path] == want
