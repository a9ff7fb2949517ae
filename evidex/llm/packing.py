"""Order-preserving packing of tokenised documents into padded windows.

Documents follow each other by doc_id inside ranges of doc_id, one range for
each task. Every document is tokenised and closed by an end id; the ids form
one stream, and dynamic programming picks the window cuts: ends of documents
cost nothing, ends of sentences and forced cuts cost a penalty, each window
costs its padding. A cut at j after a cut at i costs

    f(j) = penalty(j) + min over j - i <= window of f(i) + window - (j - i)

so f(i) + i decides alone, and a monotone queue gives the least one of the
sliding range. The stream is handled in blocks; what follows the last cut of a
block opens the next one, so memory stays bounded by a block and the longest
document. Only the last window of a task may be much shorter; it is padded to
a power of two.

Defined cases: a null or empty text is its end id alone; rows that repeat a
doc_id, or have none, are packed each for itself, side by side, in order of
their text's hash, and may be dealt over several tasks; a null doc_id comes
first; a text of more than a window is cut; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import whole

WINDOW = 4096
END_ID = 2
#: Tokens that a cut inside a document is worth, after a sentence and elsewhere.
SENTENCE_PENALTY, FORCED_PENALTY = 8, 256
#: Tokens in a block of the dynamic program.
BLOCK_TOKENS = 1 << 19
#: Words whose ids are remembered by a worker, and the longest that is.
REMEMBERED_WORDS, REMEMBERED_CHARS = 500_000, 64
#: New words that are encoded as one line.
WORDS_IN_LINE = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The white space that parts words here. Nothing composes with it and no token crosses it; all else is left to the library.
_BREAKS = "\n\t\r\f\v"
#: Letters that normalising maps to one letter each and joins to nothing in front of a letter or a break.
_PLAIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN_WORD = re.compile(f"[{_PLAIN}]+")
#: Punctuation right behind a plain letter or a digit opens a token of its own, with or without a space between.
_PARTED = ".,;:!?"
_SPLIT_OFF = re.compile(f"(?<=[{_PLAIN}0-9])(?=[{_PARTED}])")
_BEHIND_OTHERS = re.compile(f"[^{_PLAIN}0-9 {_BREAKS}][{_PARTED}]")


def _latin(text: str) -> bool:
    """Whether lower() maps each character for itself, as the tokenizer does."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Token ids of whole texts through ids remembered by word, for tokenizers that drop white space.

    Texts are cut at ASCII white space alone, which the tokenizer's normaliser
    and pre-tokenizer never join anything over; each word is encoded by the
    library as it stands. Words of plain letters are encoded many in a line,
    where each closes with its one end-of-word token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_sentence[ends] = True
        word_ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[word_ends] = True
        self.words: dict[str, bytes] = {"": b""}

    def split(self, text: str) -> list[str]:
        if self.lower and "<|" not in text and _latin(text):
            text = text.lower()
        if _BEHIND_OTHERS.search(text):
            text = _SPLIT_OFF.sub(" ", text)
        else:
            for char in _PARTED:
                if char in text:
                    text = text.replace(char, " " + char)
        for char in _BREAKS:
            text = text.replace(char, " ")
        return text.split(" ")

    def _learn(self, new: list[str]) -> None:
        plain, rest = [], []
        for word in new:
            (plain if _PLAIN_WORD.fullmatch(word) else rest).append(word)
        for at in range(0, len(plain), 1 << 16):
            some = plain[at : at + (1 << 16)]
            lines = [some[k : k + WORDS_IN_LINE] for k in range(0, len(some), WORDS_IN_LINE)]
            found = self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
            for line, encoding in zip(lines, found):
                ids = np.array(encoding.ids, "<u4")
                ends, data, low = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist(), ids.tobytes(), 0
                if len(ends) != len(line):  # a tokenizer of another kind
                    rest.extend(line)
                    continue
                for word, high in zip(line, ends):
                    self.words[word] = data[low:high]
                    low = high
        for word, encoding in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.words[word] = np.array(encoding.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # read at each call; others set it for theirs
        split = [self.split(t) for t in texts]
        if len(self.words) > REMEMBERED_WORDS:
            self.words = {"": b""}
        new = list(set().union(*split) - self.words.keys())
        self._learn(new)
        known = self.words.__getitem__
        ids = [b"".join(map(known, words)) for words in split]
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                del self.words[word]
        return ids


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int, last: bool) -> list[int]:
    """Indexes into ``places`` where windows end; ``places`` starts at 0 and no gap is over ``window``.

    With ``last`` the final place is a cut; otherwise the cheapest place within
    a window of the end is the last cut.
    """
    at, cost = places.tolist(), penalties.tolist()
    best, before = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        while at[queue[0]] < at[j] - window:
            queue.popleft()
        before[j] = i = queue[0]
        best[j] = value = best[i] + window + cost[j]
        while queue and best[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    j = len(at) - 1
    if not last:
        # Later cuts leave less behind: compare by what the windows so far waste.
        near = range(int(np.searchsorted(places, at[-1] - window)), len(at))
        j = min(near, key=lambda k: (best[k] - at[k], -k))
    cuts = []
    while j > 0:
        cuts.append(j)
        j = before[j]
    return cuts[::-1]


class Packer:
    """Holds the part of a task's stream that is not yet cut, and yields pieces."""

    def __init__(self, window: int, ends_sentence: np.ndarray, first_sequence: int):
        self.window, self.ends_sentence, self.sequence = window, ends_sentence, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, ids already cut, ids in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.held += len(ids)

    def cut(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        stream = np.concatenate(self.ids)
        doc_ends = np.cumsum([total - gone for _, gone, total in self.docs])
        penalty = np.full(len(stream) + 1, -1, np.int32)
        penalty[1:][self.ends_sentence[np.minimum(stream, len(self.ends_sentence) - 1)]] = SENTENCE_PENALTY
        penalty[doc_ends] = 0
        penalty[0] = 0
        places = np.flatnonzero(penalty >= 0)
        if places[-1] != len(stream):  # cannot be: the last document ends there
            places = np.append(places, len(stream))
        wide = np.flatnonzero(np.diff(places) > self.window)
        if wide.size:
            forced = np.concatenate([np.arange(places[k] + self.window, places[k + 1], self.window) for k in wide])
            penalty[forced] = FORCED_PENALTY
            places = np.flatnonzero(penalty >= 0)
        cuts = places[choose_cuts(places, penalty[places], self.window, last)]
        low, doc, doc_low = 0, 0, 0
        for high in cuts.tolist():
            at = low
            while at < high:
                doc_id, gone, total = self.docs[doc]
                end = min(high, int(doc_ends[doc]))
                part = stream[at:end]
                yield doc_id, gone + at - doc_low, end - at, zlib.crc32(part.tobytes()), total, self.sequence, at - low
                at = end
                if end == doc_ends[doc]:
                    doc, doc_low = doc + 1, end
            low, self.sequence = high, self.sequence + 1
        rest = self.docs[doc:]
        if rest and low > doc_low:
            rest[0] = (rest[0][0], rest[0][1] + low - doc_low, rest[0][2])
        self.docs, self.ids, self.held = rest, [stream[low:].copy()], len(stream) - low


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document, see PIECES."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        packer = Packer(window, encoder.ends_sentence, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        names = [c.split()[0] for c in PIECES.split(", ")]

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names)

        for given in batches:
            for lo in range(0, given.num_rows, 1024):
                part = given.slice(lo, 1024)
                texts = part.column(1).to_pylist()
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    packer.add(doc_id, np.frombuffer(ids + end, "<u4"))
                    if packer.held >= BLOCK_TOKENS and (pieces := list(packer.cut(False))):
                        yield batch(pieces)
        if pieces := list(packer.cut(True)):
            yield batch(pieces)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    # Rows of one doc_id part by their text, copies of one row by place, so no id holds a range alone.
    order = ["doc_id", "h", "place"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(packed, PIECES)
