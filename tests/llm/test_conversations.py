"""Conversation repair against a search over all scripts of edits, and a replay in plain Python."""

import binascii
import hashlib
import heapq
import random
import re

import pytest

from evidex.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, head string, kind int, conv string"
LEGAL = re.compile(r"(s?(ua)+)?")


def best(rows):
    """(cost, script) of the cheapest, then ASCII-least edits of ``rows`` (initial, fault), by search over prefixes of roles."""
    state = lambda r: re.sub(r"(ua)+", "ua", r)
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, script, at, roles = heapq.heappop(heap)
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, script
        if (at, roles) in seen or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        seen.add((at, roles))
        for new in "ua":
            heapq.heappush(heap, (cost + 2, script + "I", at, state(roles + new)))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 3, script + "D", at + 1, roles))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                heapq.heappush(heap, (cost + late, script + "K", at + 1, state(roles + initial)))
                for new in "ua":
                    heapq.heappush(heap, (cost + 2 + late, script + "R", at + 1, state(roles + new)))


SYMBOLS = [(role, fault) for role in "suax" for fault in conversations.FAULTS]


def symbol(role, fault):
    return chr(97 + 4 * "suax".index(role) + conversations.FAULTS.index(fault))


def test_cheapest_edits_of_shared_beginnings():
    rnd = random.Random(2)
    cases = {()} | {tuple(rnd.choice(SYMBOLS) for _ in range(rnd.randrange(1, 8))) for _ in range(1500)}
    signed = sorted(("".join(symbol(*x) for x in case), case) for case in cases)
    trie = conversations.Trie()
    for signature, case in signed:
        assert trie.solve(signature) == best(case), case
    assert len(trie.steps) < 2000


def expected(rows):
    """The report of rows (conv_id, turn, role, text) that query op13 damages."""
    after, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        code = binascii.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = ("user" if code == 4 else said(role)), said(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        for _ in range({0: 0, 3: 2}.get(code, 1)):
            after.setdefault(conv, []).append((turn, role, text))
    out = []
    for conv in ids:
        own = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, script = best([(r[:1] if r[:1] in ("s", "u", "a") else "x", f) for (_, r, _), f in zip(own, faults)])
        kept, at = [], 0
        for edit in script:
            row = (None, "", "") if edit == "I" else own[at]
            at += edit != "I"
            if edit != "D":
                kept.append([edit, row[1], row[2]])
        system = bool(kept) and kept[0][0] == "K" and kept[0][1][:1] == "s"
        for n, row in enumerate(kept[system:]):
            if row[0] != "K":
                row[1] = ("user", "assistant")[n % 2]
        text = "\n".join(f"{role}:{text}" for _, role, text in kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in conversations.FAULTS[1:]), sum(p not in ("su", "ua", "au") for p in pairs), cost, script, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(3)


def reported(spark, rows):
    return sorted((tuple(r) for r in conversations.repair_report(conversations.damaged(table(spark, rows))).collect()), key=str)


@pytest.fixture(scope="module")
def chats():
    rnd = random.Random(6)
    texts = ["Good day.", "Good day.", "Why?", "cut off", " ", "", None, "é!\t\n", "Yes! \x0b", "1.5", "a.b", "\x1c"]
    rows = []
    for conv in [*range(60), None]:
        turn = 0
        for _ in range(rnd.randrange(1, 8)):
            turn += rnd.choice([0, 1, 1, 1, 2])
            rows.append((conv, None if rnd.random() < 0.05 else turn, rnd.choice(["system", "user", "assistant", "user", "assistant", None, "", "Umpire", "umpire"]), rnd.choice(texts)))
    rows += rows[:9] + rows[:3]
    dropped = next(i for i in range(1000, 2000) if binascii.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "All gone."), (5000, 1, "user", "A very long text. " * 20_000), (5000, 2, "assistant", "x" * 100_000)]


def test_report(spark, chats):
    assert reported(spark, chats) == expected(chats)
    assert reported(spark, []) == []


def test_long_conversation_and_many_equal_ones(spark):
    turns = [(t, ("user", "assistant")[t % 2], f"Text {t % 50}.") for t in range(3000)]
    rows = [(1, *t) for t in turns] + [(c, t, r, x) for c in range(100, 160) for t, r, x in turns[:3]]
    rows = [r for r in rows if binascii.crc32(f"{r[0]}:{r[1]}".encode()) % 20 > 4]
    report = {r[0]: r for r in reported(spark, rows)}
    assert len(report) == len({r[0] for r in rows}) > 50
    kept = [r for r in rows if r[0] == 1]
    assert report[1][3] == len(kept) - len({r[2:] for r in kept}) and set(report[1][7]) <= set("DIKR")
    short = sorted(r for r in report.values() if r[0] != 1)
    assert sorted(short, key=str) == expected([r for r in rows if r[0] != 1])


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (2, 0, "user", ""), (3, 5, "user", "Why?")]
    got = sorted(tuple(r) for r in conversations.repair(table(spark, rows)).collect())
    assert got == [
        (1, 0, "K", "system", "Be kind."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hello."),
        (3, 0, "K", "user", "Why?"), (3, 1, "I", "assistant", ""),
    ]
