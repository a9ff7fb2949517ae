"""Token counts by a finite-state tokenizer compiled from a BPE piece model.

The last token of the encoding of every prefix of a text is unique, and an
encoding is right exactly when each two neighbouring tokens are, encoded
together, those two tokens again. So a deterministic transducer can read a
text once: a state holds, for every place from which a piece may still be
completed, the trie node reached, the last token before that place, and the
number of tokens up to it, relative to the present. A transition carries the
change of the number of tokens; it is negative where characters merge. States
and transitions are compiled when first met, as the whole product is large.

No piece crosses from a character to a following space marker, and characters
outside the vocabulary become bytes that merge with nothing: before the one
and after the other the transducer is in its first state again. Counts from
there to the next such place are remembered by what was read.

Texts of more than ``CHUNK`` code points become rows of chunks, so that many
tasks share one text. A chunk becomes a map from the states in which it may be
entered to (state after, tokens). Those states come from reading a little of
what stands before it, from each place where a token may have begun there;
readings fall into the same states soon, and past a marker into one. Maps
compose, and a tree of aggregates composes those of a text. A state for which
a map has no entry (readings that never met) is read in another round.

Defined cases: a null or empty text has no tokens; names of control pieces
inside texts are ordinary text; a null or repeated doc_id is passed through,
one result per row; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .piece_model import BPE, BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, PieceModel
from .scratch import Scratch
from .text import whole

LIMIT = 4096
#: Code points in a chunk of a text, those before it that are read to find its states, and maps that compose at once.
CHUNK, BEFORE, AT_ONCE = 1 << 16, 256, 32
#: Bounds on what a worker remembers: compiled transitions, pairs of pieces, and counted words.
TRANSITIONS, PAIRS, WORDS = 500_000, 500_000, 400_000

_RESTART = -1  # stands for "nothing that could merge" before a place
_START = ((0, _RESTART, 0),)
_NO_PAIR = float("inf")


class PieceTransducer:
    """Deterministic transducer from characters to changes of the token count."""

    def __init__(self, model: PieceModel):
        if model.model_type != BPE or not model.byte_fallback or not model.plain():
            raise ValueError("a BPE model with byte fallback and plain normalising is needed")
        if set(model.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined pieces are not supported")
        self.rank = {p: -s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in self.rank):
            raise ValueError("a piece crosses a space marker")
        self.chars = {p for p in self.rank if len(p) == 1}
        self.longest = max(map(len, self.rank))
        # Trie: node -> {character: (node, piece or None)}; pieces that encode to others never end a path.
        self.trie: list[dict[str, list]] = [{}]
        for piece in self.rank:
            if self.merged(piece) != [piece]:
                continue
            node = 0
            for i, char in enumerate(piece):
                step = self.trie[node].setdefault(char, [len(self.trie), None])
                if step[0] == len(self.trie):
                    self.trie.append({})
                if i == len(piece) - 1:
                    step[1] = piece
                node = step[0]
        self.reset()

    def reset(self) -> None:
        """Forget what was compiled."""
        self.states, self.number = [_START], {_START: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.compiled = 0

    def state(self, content: tuple) -> int:
        """The number of a state here, where it may be new."""
        if content not in self.number:
            self.number[content] = len(self.states)
            self.states.append(content)
            self.moves.append({})
        return self.number[content]

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored pair joins first, of equals the leftmost."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            ranks = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not ranks:
                break
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, left: str | int, right: str) -> bool:
        """Whether encoding both pieces together gives them again: no pair over the border joins."""
        if left == _RESTART:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._no_join_over(left + right, len(left) - 1)
        return known

    def _no_join_over(self, text: str, border: int) -> bool:
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b, _NO_PAIR) for a, b in zip(parts, parts[1:])]
        while (best := min(ranks)) is not _NO_PAIR:
            i = ranks.index(best)
            if i == border:
                return False
            parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + joined, _NO_PAIR)
            if i < len(ranks):
                ranks[i] = rank.get(joined + parts[i + 1], _NO_PAIR)
            border -= i < border
        return True

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition of ``state`` on ``char``: next state and change of the token count."""
        if self.compiled >= TRANSITIONS:
            content = self.states[state]
            self.reset()
            state = self.state(content)
        if char not in self.chars:
            move = 0, len(char.encode())
        else:
            longer, last, change, content = [], None, 0, self.states[state]
            if char == SPACE and content[-1][1] != _RESTART and content[-1][1][-1] != SPACE:
                content = _START
            for node, before, tokens in content:
                step = self.trie[node].get(char)
                if step is None:
                    continue
                if step[1] and last is None and self.stay_apart(before, step[1]):
                    last, change = step[1], tokens + 1
                if self.trie[step[0]]:
                    longer.append((step[0], before, tokens))
            if last is None:
                raise ValueError(f"no encoding ends at {char!r}")
            move = self.state((*((n, b, t - change) for n, b, t in longer), (0, last, 0))), change
        self.moves[state][char] = move
        self.compiled += 1
        return move

    def run(self, symbols: str, state: int = 0) -> tuple[int, int]:
        """(state after, tokens) of reading ``symbols`` from ``state``; what was compiled may be forgotten meanwhile."""
        total, moves = 0, self.moves
        for char in symbols:
            move = moves[state].get(char)
            if move is None:
                move = self.compile(state, char)
                moves = self.moves
            state = move[0]
            total += move[1]
        return state, total


_PARTS = re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|^[^{SPACE}\n]+")


class TokenCounter:
    """Counts by transducer; the count from a restart to the next is remembered by its symbols."""

    def __init__(self, model: PieceModel):
        self.transducer = PieceTransducer(model)
        self.words: dict[str, int] = {}

    def word(self, symbols: str) -> int:
        known = self.words.get(symbols)
        if known is None:
            if len(self.words) > WORDS:
                self.words.clear()
            known = self.transducer.run(symbols)[1]
            if len(symbols) < 64:
                self.words[symbols] = known
        return known

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        words, total = self.words, 0
        for part in _PARTS.findall(SPACE + text.replace(" ", SPACE)):
            known = words.get(part)
            total += self.word(part) if known is None else known
        return total

    def read(self, symbols: str, content: tuple) -> tuple[tuple, int]:
        """(state after, tokens) of reading on from a state."""
        parts = _PARTS.findall(symbols)
        # What opens with a marker may go on with a run of them; what follows the first part starts afresh.
        first = parts[0] if len(parts) > 1 else symbols
        state, total = self.transducer.run(first, self.transducer.state(content))
        if len(parts) > 1:
            total += sum(map(self.word, parts[1:-1]))
            state, tokens = self.transducer.run(parts[-1])
            total += tokens
        return self.transducer.states[state], total

    def entered(self, before: str) -> list[tuple]:
        """States in which a chunk may be entered, by what stands before it; one if a marker or a new line does."""
        parts = _PARTS.findall(before)
        if len(parts) > 1:
            return [self.read(parts[-1], _START)[0]]
        return list(dict.fromkeys(self.read(before[at:], _START)[0] for at in range(min(len(before), self.transducer.longest))))


_counters: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """One counter for each worker and file."""
    if path not in _counters:
        _counters[path] = TokenCounter(PieceModel.load(path))
    return _counters[path]


_MAP = "array<struct<entered:string,left:string,tokens:long>>"
_CHUNK_MAP = f"r long, doc_id long, n_bytes long, pos long, map {_MAP}"


def _packed(content: tuple) -> str:
    return json.dumps(content, ensure_ascii=False)


def _unpacked(state: str) -> tuple:
    return tuple(map(tuple, json.loads(state)))


def _mapped(model_path: str):
    """The map of each chunk; from the states in ``asked``, or else from those in which it may be entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(model_path)
        kind = pa.list_(pa.struct([("entered", pa.string()), ("left", pa.string()), ("tokens", pa.int64())]))
        for given in batches:
            maps = []
            for pos, before, chunk, asked in zip(*(given.column(c).to_pylist() for c in ("pos", "before", "chunk", "asked"))):
                before, chunk = before.replace(" ", SPACE), chunk.replace(" ", SPACE)
                if asked:
                    states = [_unpacked(asked)]
                elif pos:
                    states = counter.entered(before)
                else:
                    states, chunk = [_START], SPACE + chunk
                entries = []
                for state in states:
                    left, tokens = counter.read(chunk, state)
                    entries.append({"entered": _packed(state), "left": _packed(left), "tokens": tokens})
                maps.append(entries)
            yield pa.RecordBatch.from_arrays([given.column(c) for c in ("r", "doc_id", "n_bytes", "pos")] + [pa.array(maps, kind)], ["r", "doc_id", "n_bytes", "pos", "map"])

    return run


def _then(first: Column, second: Column) -> Column:
    """The composed map; an entry whose state the second doesn't know leaves nowhere."""

    def entry(e: Column) -> Column:
        on = F.get(F.filter(second, lambda x: x["entered"] == e["left"]), 0)
        return F.named_struct(F.lit("entered"), e["entered"], F.lit("left"), on["left"], F.lit("tokens"), e["tokens"] + on["tokens"])

    return F.transform(first, entry)


def _composed(maps: DataFrame, scratch: Scratch) -> DataFrame:
    """One map for each text, by a tree of aggregates over ``AT_ONCE`` neighbours."""
    longest = maps.agg(F.max("pos")).first()[0] or 0
    while longest > 0:
        near = F.array_sort(F.collect_list(F.struct("pos", "map")))
        groups = maps.groupBy("r", "doc_id", "n_bytes", F.floor(F.col("pos") / AT_ONCE).alias("pos")).agg(near.alias("near"))
        one = F.aggregate(F.slice("near", 2, AT_ONCE), F.get("near", 0)["map"], lambda m, x: _then(m, x["map"]))
        maps, longest = groups.select("r", "doc_id", "n_bytes", "pos", one.alias("map")), longest // AT_ONCE
    return scratch.write(maps.select("r", "doc_id", "n_bytes", F.get("map", 0).alias("whole")), "composed")


def _unknown(maps: DataFrame) -> DataFrame:
    """(r, pos, asked): where the reading of a text, from its start, first meets a state that the next map lacks."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "map")))
    start = F.named_struct(F.lit("pos"), F.lit(-1).cast("long"), F.lit("state"), F.lit(_packed(_START)), F.lit("lost"), F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        on = F.get(F.filter(x["map"], lambda e: e["entered"] == acc["state"]), 0)
        go = F.named_struct(F.lit("pos"), x["pos"], F.lit("state"), F.coalesce(on["left"], acc["state"]), F.lit("lost"), on.isNull())
        return F.when(acc["lost"], acc).otherwise(go)

    found = maps.groupBy("r").agg(steps.alias("steps")).select("r", F.aggregate("steps", start, step).alias("at"))
    return found.where("at.lost").select("r", "at.pos", F.col("at.state").alias("asked"))


def long_counts(rows: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts whose chunks many tasks share."""
    scratch = Scratch(rows.sparkSession, "token-counts")
    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    with_before = lambda c, i: F.named_struct(F.lit("pos"), i.cast("long"), F.lit("before"), F.when(i > 0, F.right(F.get("cuts", i - 1), F.lit(BEFORE))).otherwise(""), F.lit("chunk"), c)
    chunks = rows.select(F.monotonically_increasing_id().alias("r"), "doc_id", "n_bytes", F.explode(F.array(cuts)).alias("cuts"))
    chunks = chunks.select("r", "doc_id", "n_bytes", F.explode(F.transform("cuts", with_before)).alias("c")).select("r", "doc_id", "n_bytes", "c.*")
    chunks = scratch.write(chunks.repartition("r", "pos"), "chunks")
    asked = F.lit(None).cast("string").alias("asked")
    maps = scratch.write(chunks.select("*", asked).mapInArrow(_mapped(model_path), _CHUNK_MAP), "maps")
    while True:
        composed = _composed(maps, scratch)
        lost = composed.where("whole.left is null")
        if lost.isEmpty():
            return composed.select("doc_id", "n_bytes", F.col("whole.tokens").alias("n_tokens"))
        again = _unknown(maps.join(lost.select("r"), "r", "left_semi"))
        found = chunks.join(again, ["r", "pos"]).mapInArrow(_mapped(model_path), _CHUNK_MAP)
        more = maps.unionByName(found).groupBy("r", "doc_id", "n_bytes", "pos").agg(F.flatten(F.collect_list("map")).alias("map"))
        maps = scratch.write(more, "maps")


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(model_path)
        for given in batches:
            counts = [counter.count(text.as_py()) for text in given.column(1)]
            yield pa.RecordBatch.from_arrays(
                [given.column(0), given.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = whole(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    # Bytes tell most texts apart without counting their code points.
    is_long = (F.col("n_bytes") > chunk) & (F.char_length("text") > chunk)
    counts = rows.where(~is_long).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    counts = counts.unionByName(long_counts(rows.where(is_long), model_path, chunk))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
