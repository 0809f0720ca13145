"""Reader of a SentencePiece model file: a few protobuf fields, decoded by hand, so that no generated code is needed."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Fixed values of the model format: the kinds of pieces and the two segmentation algorithms built here.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The marker that stands for a space inside pieces.
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of one message; nested messages, strings and fixed numbers stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} is not part of the model format")
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class PieceModel:
    """What encoding needs: pieces by id, and the settings of trainer and normaliser."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    charsmap: bytes = b""

    @classmethod
    def parse(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.of(f.read())

    @classmethod
    def of(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                got = dict(fields(value))
                out.pieces.append(got.get(1, b"").decode())
                out.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                out.kinds.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(fields(value))
                out.algorithm = got.get(3, UNIGRAM)
                out.byte_fallback = bool(got.get(35, 0))
                out.unknown = got.get(40, 0)
            elif number == 3:
                got = dict(fields(value))
                out.charsmap = got.get(2, b"")
                out.dummy_prefix = bool(got.get(3, 1))
                out.squeeze_spaces = bool(got.get(4, 1))
                out.escape_spaces = bool(got.get(5, 1))
        return out

    def splits_at_spaces(self) -> bool:
        """Whether no piece holds a space marker after another character: words then never influence each other."""
        return not any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED))

    def check_plain(self) -> None:
        """Raises ValueError for settings that the word-wise coders do not rebuild."""
        if self.charsmap or self.squeeze_spaces or not self.escape_spaces or not self.dummy_prefix:
            raise ValueError("only models without character map, with kept spaces and a leading marker are rebuilt")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces are not rebuilt")
        if not self.splits_at_spaces():
            raise ValueError("pieces across spaces are not rebuilt")
