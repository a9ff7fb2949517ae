"""Reader for SentencePiece model files: the protobuf wire format, field by field."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

SPACE = "▁"  # the metaspace marker
#: Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(field number, value) of a message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind} is not part of a model file")
        yield key >> 3, value


@dataclass
class PieceModel:
    """What encoding needs of a model file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                part = dict(fields(value))
                out.pieces.append(part.get(1, b"").decode())
                out.scores.append(part.get(2, 0.0))
                out.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                out.model_type, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                out.unk_id = spec.get(40, 0)
            elif number == 3:
                spec = dict(fields(value))
                out.charsmap = spec.get(2, b"")
                out.dummy_prefix, out.squeeze, out.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return out

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as file:
            return cls.parse(file.read())

    def plain(self) -> bool:
        """Whether normalising is only the marker for spaces and one before the text."""
        return not self.charsmap and self.dummy_prefix and self.escape and not self.squeeze
