"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed, and normaliser, metaspace marker, piece scores
and byte fallback are rebuilt as a tokenizers pipeline: merges in score order
for BPE models, scored pieces for unigram ones. Batches are encoded by the
library's threads. Where no piece crosses a space marker, a text is its parts
one after the other, so each distinct part is encoded once for many
occurrences; its parity with the sentencepiece library is verified then. Merges
of one piece have ranks of their own here and one score there, so parts such as
runs of a marker can differ: they get the library's ids, and texts that hold
them have ``parity`` false. One text of each slice, and each that holds such a
part, is verified whole besides.

Defined cases: null and empty texts have no ids; names of control pieces in a
text are ordinary text; a null or repeated doc_id is passed through, one
result per row; a very long text is one row, and parts of over
``REMEMBERED_CHARS`` are not remembered; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_model import BPE, BYTE, NORMAL, SPACE, UNIGRAM, USER_DEFINED, PieceModel
from .text import whole

#: Distinct parts that a worker remembers, and the longest that is remembered.
REMEMBERED, REMEMBERED_CHARS = 250_000, 64
#: Threads of the tokenizers library in a worker; each keeps memory of its own.
THREADS = 2
#: Rows that a worker turns into Python objects at once.
ROWS_AT_ONCE = 512
#: New parts that are encoded as one line.
PARTS_IN_LINE = 64

_PARTS = re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


def rebuilt(model: PieceModel, normalise: bool = True):
    """The model as a tokenizer of the tokenizers library; without ``normalise`` it takes normalised parts."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.model_type == BPE:
        ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds))}
        joined = {p: i for p, i in ids.items() if model.kinds[i] in (NORMAL, USER_DEFINED)}
        merges = [
            (-model.scores[i], p, joined[p[:at]], joined[p[at:]], (p[:at], p[at:]))
            for p, i in joined.items()
            for at in range(1, len(p))
            if p[:at] in joined and p[at:] in joined
        ]
        merges = [m[-1] for m in sorted(merges)]
        tokenizer = Tokenizer(models.BPE(ids, merges, unk_token=model.pieces[model.unk_id], byte_fallback=model.byte_fallback))
    elif model.model_type == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), model.unk_id, model.byte_fallback))
    else:
        raise ValueError(f"model type {model.model_type} is not supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    if normalise:
        tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


def in_lines(tokenizer):
    """The same model for lines of many parts, each with one marker in front."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(tokenizer.model)
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="never", split=True)
    return out


class PieceDecoder:
    """Text of ids by the rebuilt decoder. It treats pieces one by one but for runs of bytes, so each piece is decoded once, and each such run."""

    def __init__(self, path: str):
        self.model = PieceModel.load(path)
        self.tokenizer = rebuilt(self.model)
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])
        self.pieces = self._decoded([[i] for i in range(len(self.model.pieces))])
        self.runs: dict[bytes, str] = {}

    def _decoded(self, given: list[list[int]]) -> list[str]:
        """Decode behind a piece that keeps its place: the decoder treats only the front of a whole text otherwise."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        guard = [i for i, p in enumerate(self.model.pieces) if p == "x" or p == SPACE + "x"][:1] or [self.model.pieces.index(SPACE)]
        front = len(self.tokenizer.decode(guard, skip_special_tokens=False))
        return [t[front:] for t in self.tokenizer.decode_batch([guard + ids for ids in given], skip_special_tokens=False)]

    def decode(self, texts: list[bytes]) -> list[str]:
        """Texts of little-endian 32-bit ids; a marker before the text goes, bytes that are no UTF-8 are replaced."""
        numbers = [np.frombuffer(data, "<u4") for data in texts]
        # Where runs of bytes begin and end in each text.
        cuts = [np.flatnonzero(np.diff(self.is_byte[ids], prepend=False, append=False)).reshape(-1, 2).tolist() for ids in numbers]
        new = list({ids[i:j].tobytes() for ids, at in zip(numbers, cuts) for i, j in at} - self.runs.keys())
        self.runs.update(zip(new, self._decoded([np.frombuffer(run, "<u4").tolist() for run in new]) if new else ()))
        out, piece = [], self.pieces.__getitem__
        for ids, at in zip(numbers, cuts):
            parts, done = [], 0
            for i, j in at:
                parts += [*map(piece, ids[done:i].tolist()), self.runs[ids[i:j].tobytes()]]
                done = j
            parts += map(piece, ids[done:].tolist())
            text = "".join(parts)
            out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        for run in new:
            if len(run) > 4 * REMEMBERED_CHARS:
                self.runs.pop(run, None)
        return out


class PieceEncoder:
    """Encoder and parity check of one model file."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        self.model = PieceModel.load(path)
        normal = [p for p, k in zip(self.model.pieces, self.model.kinds) if k == NORMAL]
        #: Whether texts fall into parts that can be encoded one by one.
        self.by_part = self.model.plain() and "\n" not in "".join(normal) and not any(
            SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in normal
        )
        self.tokenizer = rebuilt(self.model, normalise=not self.by_part)
        self.lines = in_lines(self.tokenizer)
        self.opens = np.array([p[0] == SPACE for p in self.model.pieces])
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def _learn(self, parts: list[str]) -> None:
        """Encode parts; those with one marker go in lines, where each token with a marker opens a part."""
        marked = re.compile(f"{SPACE}[^{SPACE}]").match
        plain, rest = [p for p in parts if marked(p)], [p for p in parts if not marked(p)]
        lines = [plain[k : k + PARTS_IN_LINE] for k in range(0, len(plain), PARTS_IN_LINE)]
        # The library puts a marker in front, so lines and parts are given without their own.
        theirs = self.library.encode(["".join(line)[1:].replace(SPACE, " ") for line in lines])
        ours = self.lines.encode_batch_fast(["".join(line) for line in lines], add_special_tokens=False)
        for line, mine, other in zip(lines, ours, theirs):
            numbers = mine.ids
            ids = np.array(numbers, "<u4")
            starts, data = (4 * np.flatnonzero(self.opens[ids])).tolist(), ids.tobytes()
            if len(starts) != len(line):
                raise ValueError("a part does not open with one marked token")
            for part, low, high in zip(line, starts, [*starts[1:], len(data)]):
                self.known[part] = data[low:high]
            if numbers != other:
                self._compare(line)
        for part, mine in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[part] = np.array(mine.ids, "<u4").tobytes()
        self._compare(rest)

    def _compare(self, parts: list[str]) -> None:
        """Note the parts that the library encodes otherwise."""
        for part, theirs in zip(parts, self.library.encode([p[1:] if p[0] == SPACE else p for p in parts])):
            if part == SPACE:  # the library gives an empty text no marker
                theirs = [self.library.piece_to_id(SPACE)]
            elif part[0] != SPACE:
                theirs = theirs[1:]
            exact = np.array(theirs, "<u4").tobytes()
            if self.known[part] != exact:
                self.differing.add(part)
                self.known[part] = exact

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(little-endian 32-bit ids, parity) of each text: parity says that the rebuilt tokenizer needed no correction."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # read at each call; others set it for theirs
        if not self.by_part:
            ours = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            pairs = zip((e.ids for e in ours), self.library.encode(texts))
            return [(np.array(b, "<u4").tobytes(), a == b) for a, b in pairs]
        split = [_PARTS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.differing.clear()
        new = list(set().union(*split) - self.known.keys())
        for lo in range(0, len(new), 5_000):
            self._learn(new[lo : lo + 5_000])
        ids = [b"".join(map(self.known.__getitem__, parts)) for parts in split]
        parity = [not self.differing or self.differing.isdisjoint(parts) for parts in split]
        for part in new:
            if len(part) > REMEMBERED_CHARS:
                del self.known[part]
                self.differing.discard(part)
        verified = [i for i, same in enumerate(parity) if not same or i == 0]
        for i, theirs in zip(verified, self.library.encode([texts[i] for i in verified])):
            exact = np.array(theirs, "<u4").tobytes()
            if ids[i] != exact:
                ids[i], parity[i] = exact, False
        return list(zip(ids, parity))


_loaded: dict[tuple, PieceEncoder | PieceDecoder] = {}


def loaded(kind: type, path: str) -> PieceEncoder | PieceDecoder:
    """One encoder or decoder for each worker and file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text, ids, parity) for each row of ``docs``; ids are little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(PieceEncoder, model_path)
        for given in batches:
            for lo in range(0, given.num_rows, ROWS_AT_ONCE):
                part = given.slice(lo, ROWS_AT_ONCE)
                ids, parity = zip(*codec.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(parity, pa.bool_())],
                    ["doc_id", "text", "ids", "parity"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids binary, parity boolean")


def decoded_digest(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip, parity) of encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(PieceDecoder, model_path)
        names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        for given in batches:
            for lo in range(0, given.num_rows, ROWS_AT_ONCE):
                rows = []
                part = given.slice(lo, ROWS_AT_ONCE)
                doc_ids, texts, encoded_ids, parities = (part.column(i).to_pylist() for i in range(4))
                for doc_id, text, ids, parity, back in zip(doc_ids, texts, encoded_ids, parities, codec.decode(encoded_ids)):
                    # The marker itself is the one character that comes back as another: a space.
                    same = back == text.replace(SPACE, " ")
                    digest = hashlib.sha256(back.encode()).hexdigest()
                    rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), digest, same, parity))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return encoded.mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"
    )
