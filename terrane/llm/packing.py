"""Packing of token sequences by minimum bin slack.

Every document is its ids and an end id. What fills whole sequences is cut off; the remainders wait in a window of
bounded size. For each sequence the longest waiting remainder is set, and a subset-sum dynamic program over the lengths
that wait - one bitset of reachable sums a length, held as an integer - finds the fullest filling and, backtracked,
how many of each length make it. A filling that falls short is completed by a cut of the shortest remainder that is
longer than the gap. Only what is left at the end of a partition is shorter: it is laid out in sequences whose lengths
are powers of two, which need no padding.

Packing is local to a partition: no shuffle, and memory is bounded by the window and one batch of texts. Sequence ids
carry the partition's number above 33 bits. A retried task reads the same rows in the same order and so packs alike.

Defined results: a null or empty text is one piece, the end id alone; equal texts and equal ids give pieces each;
no other column is read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from terrane.llm.text import lean

#: Remainders that wait before sequences are built, and how many are left waiting for later ones.
WINDOW, KEEP = 2048, 512
BLOCK_CHARS = 1 << 22
#: Characters on whose classes any two Unicode versions agree; texts with others are encoded by the tokenizers library.
_COMMON = re.compile("[\\x20-\\x7e\\t\\n\\r\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: The pattern that cuts texts before the merges of byte-level vocabularies, and their way to write bytes (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Ids:
    """Ids of texts under a byte-level tokenizer file.

    The tokenizers library defines them. The same merges run five times faster in the tiktoken library, which is used
    for texts of common characters without special strings; the first text of every block is encoded by both, and the
    whole block by tokenizers should they ever differ.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain and made == sorted(made) else None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return self._whole(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        rest, checked = [], False
        for i, text in enumerate(texts):
            if _COMMON.fullmatch(text) is None or any(s in text for s in self.special):
                rest.append(i)
                continue
            out[i] = np.array(self.fast.encode_ordinary(text), np.uint32)
            if not checked:
                if not np.array_equal(out[i], self._whole([text])[0]):
                    return self._whole(texts)
                checked = True
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Ids:
    return Ids(path)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the largest sum of at most ``capacity``, by a bitset dynamic program.

    Counts are taken apart in powers of two, so that each (length, number) is used whole or not at all; the bitset after
    every step is kept, and walking back over them tells which were used.
    """
    limit = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length if length else 0), 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & limit
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


class Packer:
    """Packs (key, start, length) pieces into sequences; ``emit`` gets (piece, sequence, offset)."""

    def __init__(self, capacity: int, first: int, emit: Callable[[tuple, int, int], None]):
        self.capacity, self.next, self.emit = capacity, first, emit
        self.waiting: dict[int, list[tuple]] = {}
        self.n = 0

    def add(self, piece: tuple) -> None:
        """A piece is (row, start, length, ...); whole sequences are cut off its front."""
        row, start, length = piece
        while length >= self.capacity:
            self.emit((row, start, self.capacity), self.next, 0)
            self.next, start, length = self.next + 1, start + self.capacity, length - self.capacity
        if length:
            self._wait((row, start, length))
        if self.n >= WINDOW:
            self.build(KEEP)

    def _wait(self, piece: tuple) -> None:
        self.waiting.setdefault(piece[2], []).append(piece)
        self.n += 1

    def _take(self, length: int) -> tuple:
        same = self.waiting[length]
        piece = same.pop()
        if not same:
            del self.waiting[length]
        self.n -= 1
        return piece

    def build(self, keep: int) -> None:
        """Builds full sequences while more than ``keep`` remainders wait and they hold enough."""
        while self.n > keep:
            if sum(k * len(v) for k, v in self.waiting.items()) < self.capacity and keep == 0:
                return
            bin_ = [self._take(max(self.waiting))]
            gap = self.capacity - bin_[0][2]
            for length, times in fullest({k: len(v) for k, v in self.waiting.items()}, gap).items():
                bin_ += [self._take(length) for _ in range(times)]
                gap -= length * times
            if gap:
                longer = [k for k in self.waiting if k > gap]
                if longer:
                    row, start, length = self._take(min(longer))
                    bin_.append((row, start, gap))
                    self._wait((row, start + gap, length - gap))
                else:
                    # All that waits is shorter than the gap, and yet does not fit: nothing waits.
                    for piece in bin_:
                        self._wait(piece)
                    return
            self._lay(bin_)

    def _lay(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.emit(piece, self.next, offset)
            offset += piece[2]
        self.next += 1

    def close(self) -> None:
        """The end of the partition: full sequences first, then powers of two."""
        self.build(0)
        rest = [p for k in sorted(self.waiting, reverse=True) for p in self.waiting[k]]
        self.waiting, self.n = {}, 0
        total = sum(p[2] for p in rest)
        while total:
            size, bin_ = min(self.capacity, 1 << (total.bit_length() - 1)), []
            total -= size
            while size:
                row, start, length = rest.pop(0)
                used = min(size, length)
                bin_.append((row, start, used))
                if used < length:
                    rest.insert(0, (row, start + used, length - used))
                size -= used
            self._lay(bin_)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        packer = Packer(capacity, base, lambda piece, sequence, offset: out.append((*piece, sequence, offset)))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*[(d, s, n, zlib.crc32(i[s : s + n].tobytes()), len(i), q, o) for (d, i), s, n, q, o in out], strict=True)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            at, part, n = 0, [], 0
            texts = batch.column(1)
            for k in range(len(ids)):
                part.append(texts[k].as_py() or "")
                n += len(part[-1])
                if n >= BLOCK_CHARS or k == len(ids) - 1:
                    for doc, found in zip(ids[at : k + 1], coder.encode(part), strict=True):
                        full = np.append(found, np.uint32(end_id)).astype("<u4")
                        packer.add(((doc, full), 0, len(full)))
                    at, part, n = k + 1, [], 0
                    if out:
                        yield rows()
        packer.close()
        yield rows()

    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return source.mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
