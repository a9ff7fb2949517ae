"""Conversation structure repair: the cheapest edits, found once for every shared beginning of role and fault signatures.

A conversation's rows, in the order of their turns, become a signature of one
symbol a row: whose turn it is and what is wrong with it. Distinct signatures
are dealt by ranges and sorted, which makes each task walk a prefix trie: what
a signature shares with the one before keeps its layers, only the rest is
computed, and the answer is read off where the signature ends. A layer has, for
each state of the pattern ``(s?(ua)+)?``, the least cost so far and the order
of the cheapest scripts. There are only some hundred layers, as states that
can't win any more are left out, and transitions are remembered; a task stores
two numbers for each symbol of the signature at hand.

Equal signatures are one, so a conversation that many ids repeat is solved
once. Rows equal in id, turn, role and text are counted before they are
ordered; the order is made by ranges, so a conversation of any length fills as
many tasks as it needs until its signature is put together, one byte a row, as
long as the edits that are asked for. The texts move once, sorted by
conversation, and stream past the edits: an SHA-256 is sequential, so one
conversation's repaired text is hashed by one task, in batches.

Defined cases: null role or text is one space; null ids are one conversation;
null turns come first; rows of one turn are ordered by role, then by the text's
SHA-256; an empty role or one with another initial than s, u, a must be
changed or deleted; a conversation whose rows are all gone has zeros, no edits
and the hash of nothing; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import placed
from .scratch import Scratch
from .text import WHITE_SPACE

#: A symbol is ROLES and FAULTS at once: "a" for the first of each, then "b", faults running faster.
ROLES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
#: States of the pattern, and where each leads: what is inserted or given another role is determined by it.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A state that costs more than the best one by this goes on cheaper from there: two inserts reach its phase, a system row is deleted.
MARGIN = 2 * INSERT + DELETE
#: (cost or None, rank among the scripts of this layer) for each state.
START = ((0, 0), (None, 0), (None, 0), (None, 0))


def _inserted(layer: tuple) -> Iterator[tuple[int, int, int, str, int]]:
    """(state, cost, rank, inserts, parent) after no, one or two inserts; a third leads where one does."""
    for parent, (cost, rank) in enumerate(layer):
        if cost is not None:
            state = parent
            for n in range(3):
                yield state, cost + INSERT * n, rank, "I" * n, parent
                state = NEXT[state]


@lru_cache(maxsize=1 << 16)
def step(layer: tuple, symbol: str) -> tuple[int, tuple, tuple]:
    """(added to every cost, next layer, (parent, letters) of each state) after one more row.

    Scripts of one layer end in a row's letter and have as many of those, so
    none begins another; two with different parents differ as these do.
    """
    role, fault = divmod(ord(symbol) - 97, len(FAULTS))
    initial, more = ROLES[role : role + 1], LEFT_TRUNCATED * (fault == TRUNCATED)
    best: dict[int, tuple] = {}

    def offer(state: int, cost: int, rank: int, letters: str, parent: int) -> None:
        if state not in best or (cost, rank, letters) < best[state][:3]:
            best[state] = (cost, rank, letters, parent)

    for state, cost, rank, inserts, parent in _inserted(layer):
        offer(state, cost + DELETE, rank, inserts + "D", parent)
        if fault not in (BLANK, DUPLICATE):
            offer(NEXT[state], cost + REROLE + more, rank, inserts + "R", parent)
            if (state, initial) in KEPT:
                offer(KEPT[state, initial], cost + more, rank, inserts + "K", parent)
    low = min(b[0] for b in best.values())
    best = {state: b for state, b in best.items() if b[0] <= low + MARGIN}
    ranks = {state: n for n, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    new = tuple((best[s][0] - low, ranks[s]) if s in best else (None, 0) for s in range(4))
    return low, new, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


@lru_cache(maxsize=1 << 12)
def finish(layer: tuple) -> tuple[int, int, str]:
    """(cost, state, letters) of the cheapest end in a state that the pattern accepts."""
    ends = [(cost, rank, inserts, parent) for state, cost, rank, inserts, parent in _inserted(layer) if state in (EMPTY, ASSISTANT)]
    cost, _, inserts, parent = min(ends)
    return cost, parent, inserts


class Trie:
    """The path of a prefix trie down to the signature at hand; signatures come in order."""

    def __init__(self):
        self.steps: list[tuple] = []
        self.known: dict[tuple[tuple, str], int] = {}
        self.signature, self.path, self.costs = "", array("i"), array("q")

    def _shared(self, signature: str) -> int:
        a, b = self.signature, signature
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, edits' letters)."""
        depth = self._shared(signature)
        del self.path[depth:], self.costs[depth:]
        self.signature = signature
        layer, cost = (self.steps[self.path[-1]][1], self.costs[-1]) if depth else (START, 0)
        for symbol in signature[depth:]:
            at = self.known.get((layer, symbol))
            if at is None:
                at = self.known[layer, symbol] = len(self.steps)
                self.steps.append(step(layer, symbol))
            more, layer, _ = self.steps[at]
            cost += more
            self.path.append(at)
            self.costs.append(cost)
        last, state, letters = finish(layer)
        out = [letters]
        for at in reversed(self.path):
            state, letters = self.steps[at][2][state]
            out.append(letters)
        return cost + last, "".join(reversed(out))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for batch in batches:
        out = []
        for signature in batch.column(0).to_pylist():
            codes = np.frombuffer(signature.encode(), np.uint8) - 97
            role, faults = codes // len(FAULTS), np.bincount(codes % len(FAULTS), minlength=len(FAULTS))
            legal = [ROLES.index(a) * 4 + ROLES.index(b) for a, b in ("su", "ua", "au")]
            illegal = int((~np.isin(role[:-1] * 4 + role[1:], legal)).sum())
            out.append((signature, *(int(faults[k]) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal, *trie.solve(signature)))
        types = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): one in twenty rows each is dropped (times 0), emptied, robbed of its full stops, repeated, given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), times.alias("times"))


def _rows(rows: DataFrame) -> DataFrame:
    """Rows as they are ordered: ``conv`` wraps the id, so that null is an id like any other wherever rows meet."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    plain = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), times.alias("times"))
    return plain.select(F.struct("conv_id").alias("conv"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "times")


def _flaw(text: Column) -> Column:
    bare = F.rtrim(text, F.lit(WHITE_SPACE))
    return F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)


def edits(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(conv, gaps, signature, blank, duplicate, truncated, illegal, cost, audit) for each conversation of ``rows``.

    ``rows`` (conv_id, turn, role, text) may have ``times``: how often a row is there, 0 for not at all.
    """
    scratch, order = scratch or Scratch(rows.sparkSession, "conversations"), ["turn", "role", "digest"]
    given = _rows(rows)
    there = F.when(F.col("times") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(there) - F.min(there) + 1 - F.countDistinct(there), F.lit(0))
    every = given.groupBy("conv").agg(gaps.cast("long").alias("gaps"))
    light = given.where("times > 0").select("conv", *order, _flaw(F.col("text")).alias("flaw"), "times")
    counted = scratch.write(light.groupBy("conv", *order).agg(F.max("flaw").alias("flaw"), F.sum("times").alias("n")), "rows")
    first = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.left("role", F.lit(1))), F.lit(0))
    at = F.when(role > 0, role - 1).otherwise(len(ROLES)) * len(FAULTS)
    blank, new = F.col("flaw") == BLANK, F.struct("turn") == F.col("first")
    symbol = lambda fault: F.chr((at + fault + 97).cast("long"))
    head, rest = symbol(F.when(blank | new, F.col("flaw")).otherwise(DUPLICATE)), symbol(F.when(blank, BLANK).otherwise(DUPLICATE))
    run = F.concat(head, F.repeat(rest, (F.col("n") - 1).cast("int")))
    symbols = counted.join(first, ["conv", "role", "digest"]).select("conv", *order, run.alias("run"))
    ordered = placed(symbols, order, ["conv"], scratch.write)
    # Parts of a conversation are put together where they lie, then the conversation.
    joined = lambda place, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, what))), lambda x: x[what]), "")
    parts = ordered.groupBy("conv", "_part").agg(joined("_nth", "run").alias("piece"))
    signed = parts.groupBy("conv").agg(joined("_part", "piece").alias("signature"))
    signed = scratch.write(every.join(signed, "conv", "left").select("conv", "gaps", F.coalesce("signature", F.lit("")).alias("signature")), "signatures")
    sorts = signed.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    answers = sorts.mapInArrow(_solved, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return signed.join(answers, "signature")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict | None, int, str, str, str]]:
    """(what, conversation, place, edit, role, text): "open", then each repaired row, then "close", from rows that follow their conversation's edits."""
    head, audit, at, state, place = None, "", 0, EMPTY, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at, state, place = at + 1, NEXT[state], place + 1
            yield "row", head, place - 1, "I", NAMES[state], ""

    for batch in batches:
        kinds, heads = batch.column("kind").to_pylist(), batch.schema.get_field_index("head")
        roles, texts, times = (batch.column(c) for c in ("role", "text", "times"))
        for i, kind in enumerate(kinds):
            if kind == 0:
                if head is not None:
                    yield from inserts()
                    yield "close", head, place, "", "", ""
                head = batch.column(heads)[i].as_py()
                audit, at, state, place = head["audit"], 0, EMPTY, 0
                yield "open", head, 0, "", "", ""
                continue
            role = roles[i].as_py()
            for _ in range(times[i].as_py()):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = NEXT[state] if edit == "R" else KEPT[state, role[:1]]
                place += 1
                yield "row", head, place - 1, edit, NAMES[state] if edit == "R" else role, texts[i].as_py()
    if head is not None:
        yield from inserts()
        yield "close", head, place, "", "", ""


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, types = [], [*[pa.int64()] * (1 + len(FIGURES)), pa.string(), pa.string()]
    names = ["conv_id", *FIGURES, "audit", "repaired_sha256"]
    digest = sha256()

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for what, head, place, _, role, text in _replayed(batches):
        if what == "open":
            digest = sha256()
        elif what == "row":
            digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
        else:
            out.append((head["conv_id"], *(head[k] for k in FIGURES), head["audit"], digest.hexdigest()))
            if len(out) == 1024:
                yield packed()
                out = []
    if out:
        yield packed()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    types, names = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "place", "edit", "role", "text"]
    for what, head, place, edit, role, text in _replayed(batches):
        if what == "row":
            out.append((head["conv_id"], place, edit, role, text))
            held += len(text)
        if len(out) == 1024 or held > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _streamed(rows: DataFrame) -> DataFrame:
    """Every conversation's edits, then its rows in order, within one partition."""
    found = edits(rows)
    head = F.struct(F.col("conv.conv_id").cast("long").alias("conv_id"), *FIGURES, "audit")
    texts = _rows(rows).where("times > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "times")
    both = texts.unionByName(found.select("conv", F.lit(0).alias("kind"), head.alias("head")), allowMissingColumns=True)
    dealt = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
    return dealt.select("kind", "head", "role", "text", "times")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of every repaired conversation, inserted ones with an empty text."""
    return _streamed(rows).mapInArrow(_listed, "conv_id long, place long, edit string, role string, text string")


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation."""
    return _streamed(rows).mapInArrow(_hashed, f"conv_id long, {', '.join(f'{k} long' for k in FIGURES)}, audit string, repaired_sha256 string")
