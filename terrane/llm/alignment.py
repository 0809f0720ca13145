"""Alignment of two tokenizers over a corpus: where tokens of both end together, and how often which ids do.

Texts are encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Neither makes a token across a space that
follows a visible character, so the words between such spaces are aligned once each and kept; a text is the sum of its words.

Each task takes its documents in blocks of bounded size and counts its pairs of ids, packed as a << 32 | b, by np.unique;
blocks and documents are written once, so no text is encoded again. Partial counts are sorted globally by ranges of the key
and summed over runs; a range is a shard of sorted keys and counts. A block then asks each shard for the keys it holds, a
key once however often it occurs in it: shards come as rows before the questions, are laid out in a file of the task's own,
mapped into memory and searched, and the file goes with the task. Questions of one shard are dealt to several tasks, each
with its own copy of the shard, so neither a frequent pair nor many blocks make one task large. What is held is a block, or
a batch beside a mapped shard; the driver holds the shards' first keys and one number for each id of B.

Defined results: texts that are null, empty, or not given back by the tokens' bytes have no tokens: zeros and ''. A sum over
links is a 64-bit integer. Repeated rows and equal ids are rows each; an empty table gives no row; other columns are not
read. Texts of any length are taken whole, in runs of words.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm.packing import PRINTABLE
from terrane.llm.piece_model import BYTE, SPACE, PieceModel
from terrane.llm.tables import bounded_batches, written
from terrane.llm.text import lean

#: Characters of a block's texts (a longer text is a block), and of the words a worker keeps between blocks.
BLOCK_CHARS, KEPT_CHARS = 4 << 20, 5 << 20
#: Characters of texts whose words are looked up at a time, and words that are encoded together.
RUN_CHARS, JOINED = 1 << 20, 64
#: Partial counts of a task that are merged in memory, keys of a shard, and blocks whose questions one copy of it answers.
MERGED, SHARD_KEYS, ASKED_BLOCKS = 4 << 20, 1 << 20, 64
#: Keys in a row of a shard.
CHUNK = 1 << 16
#: What may not stand before the space that ends a word: white space under any reading of it.
_SEEN = "[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b-\\u200f\\u2060\\ufeff]"
_CUT, _VISIBLE = re.compile(f"(?<={_SEEN})(?= )"), re.compile(f"{_SEEN}\\Z")
_LOW = np.int64(0xFFFFFFFF)


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, with the bytes and the number of each id's token."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run beside one another; threads of their own only cost
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        byte = byte_table()
        entries = {i: bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode() for entry, i in self.a.get_vocab().items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        model = PieceModel.parse(piece_path)
        model.check_plain()  # no piece across spaces, a marker before the text
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.marker = self.b.piece_to_id(SPACE)
        self.sizes = [np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes)]
        # Ids as they are written in a group: within a side, at the end of A's side, at the end of a group.
        written_as = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.comma, self.bar, self.semicolon = written_as(max(len(self.a_bytes), len(self.b_bytes)), ","), written_as(len(self.a_bytes), "|"), written_as(len(self.b_bytes), ";")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of texts that begin with a space, which B adds by itself."""
        first = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        second = self.b.encode([w[1:] for w in texts], num_threads=1)
        return first, [ids if w != " " else [self.marker] for w, ids in zip(texts, second, strict=True)]

    def gives_back(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = text.encode("utf-8", "surrogatepass")
        return b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole

    def align(self, words: list[str], a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Words whose bytes the tokens, laid end to end, give back, and at whose ends tokens of both end: their numbers of
        tokens of A and B and of links, the keys of the links, and the groups as text, each with a semicolon behind it."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        keys = a[np.searchsorted(ends_a, cuts)] << 32 | b[np.searchsorted(ends_b, cuts)]
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words])
        count = lambda places: np.diff(np.searchsorted(places, ends, "right"), prepend=0)
        n_a, n_b, n_links = count(ends_a), count(ends_b), count(cuts)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        text_a = np.where(cuts[group_a] == ends_a, self.bar[a], self.comma[a])
        text_b = np.where(cuts[group_b] == ends_b, self.semicolon[b], self.comma[b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        tokens = np.concatenate([text_a, text_b])[order].tolist()
        stops = np.append(0, np.cumsum(n_a + n_b)).tolist()
        return n_a, n_b, n_links, keys, ["".join(tokens[i:j]) for i, j in zip(stops, stops[1:], strict=False)]


@lru_cache(maxsize=1)
def lexicon(byte_path: str, piece_path: str) -> Lexicon:
    return Lexicon(Pair(byte_path, piece_path))


class Growing:
    """An array that is appended to."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(n, 2 * self.n) - self.n, self.held.dtype)])
        self.held[self.n : n], self.n = values, n

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Lexicon:
    """Aligned words, numbered in the order they are met; emptied between blocks once it holds enough characters. A word
    whose bytes are not given back has -1 tokens of A."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_links, self.keys = (Growing(k) for k in (np.int32, np.int32, np.int32, np.int64))
        self.chars = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.number
        fresh = sorted(set(words) - known.keys())
        if fresh:
            # Words that end visibly are encoded some together: they never influence each other.
            alone = [w for w in fresh if not _VISIBLE.search(w)]
            joined = [w for w in fresh if _VISIBLE.search(w)] if alone else fresh
            parts = [*([joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]), *([w] for w in alone)]
            self._aligned(parts)
        return np.array(list(map(known.__getitem__, words)), np.int64)

    def _aligned(self, parts: list[list[str]]) -> None:
        texts = ["".join(p) for p in parts]
        first, second = self.pair.encode(texts)
        good = [self.pair.gives_back(t, a, b) for t, a, b in zip(texts, first, second, strict=True)]
        chain = itertools.chain.from_iterable
        words = list(chain(itertools.compress(parts, good)))
        if words:
            self.add(words, *self.pair.align(words, list(chain(itertools.compress(first, good))), list(chain(itertools.compress(second, good)))))
        odd = [p for p, g in zip(parts, good, strict=True) if not g]
        for word in (p[0] for p in odd if len(p) == 1):
            self.add([word], np.array([-1]), np.zeros(1), np.zeros(1), np.zeros(0, np.int64), [""])
        if alone := [[w] for p in odd if len(p) > 1 for w in p]:
            self._aligned(alone)

    def add(self, words: list[str], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, keys: np.ndarray, groups: list[str]) -> None:
        self.number.update(zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True))
        self.groups += groups
        for held, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links), (self.keys, keys)):
            held.append(values)
        self.chars += sum(map(len, words))

    def keys_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the words one after the other, and how many each has."""
        n = self.n_links.values.astype(np.int64)
        starts, sizes = (np.cumsum(n) - n)[numbers], n[numbers]
        return self.keys.values[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)], sizes


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text that begins with a space, in runs."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + RUN_CHARS)
        end = cut.start() if cut else len(text)
        yield _CUT.split(text[at:end])
        at = end


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, each byte place by itself, so that small ones cost little."""
    raw = np.ascontiguousarray(values)
    if not len(raw):
        return b""
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class Document:
    """What is known of a document so far."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text, self.odd = doc_id, text, False
        self.n_a = self.n_b = self.n_groups = 0
        self.digest = hashlib.sha256()
        self.words, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting = ""

    def take(self, words: Lexicon, numbers: np.ndarray) -> None:
        """A run of its words."""
        n_a = words.n_a.values[numbers]
        self.odd = self.odd or bool((n_a < 0).any())
        if self.odd:
            return
        which, times = np.unique(numbers, return_counts=True)
        if len(self.words):
            which, times = summed(np.append(self.words, which), np.append(self.times, times))
        self.words, self.times = which, times
        self.n_a += int(n_a.sum())
        self.n_b += int(words.n_b.values[numbers].sum())
        self.n_groups += int(words.n_links.values[numbers].sum())
        groups = self.waiting + "".join(map(words.groups.__getitem__, numbers.tolist()))
        self.digest.update(groups[:-1].encode())
        self.waiting = ";"  # written only if there is more

    def done(self, words: Lexicon) -> None:
        """A text with a word whose bytes are not given back: its bytes as a whole decide."""
        if self.odd:
            odd, self.text = f" {self.text}", None
            self.__init__(self.doc_id, None)
            (a,), (b,) = words.pair.encode([odd])
            if words.pair.gives_back(odd, a, b):
                words.add([f"\0{odd}"], *words.pair.align([odd], a, b))  # a word of its own, which no text is looked up as
                self.take(words, np.array([len(words.groups) - 1]))
        self.text = None

    @property
    def hash(self) -> str:
        return self.digest.hexdigest() if self.n_groups else ""


class Block:
    """Documents of one task up to a bounded size, and the table rows they make."""

    def __init__(self, words: Lexicon):
        self.words, self.docs, self.chars = words, [], 0
        self.waiting: list[tuple[Document, list[str]]] = []
        self.wait_chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        doc = Document(doc_id, text)
        self.docs.append(doc)
        self.chars += len(text or "")
        for run in words_of(f" {text}") if text else ():
            self.waiting.append((doc, run))
            self.wait_chars += RUN_CHARS if len(run) > RUN_CHARS // 8 else len(text)
            if self.wait_chars >= RUN_CHARS:
                self.settle()

    def settle(self) -> None:
        """Looks up the words that wait, of many documents at once."""
        waiting, self.waiting, self.wait_chars = self.waiting, [], 0
        numbers = self.words.numbers([w for _, run in waiting for w in run])
        at = 0
        for doc, run in waiting:
            doc.take(self.words, numbers[at : at + len(run)])
            at += len(run)

    def rows(self, number: int) -> pa.Table:
        """A row for the block (its sorted keys, their counts, the keys of each word) and one for each document (its words
        and their counts)."""
        self.settle()
        for doc in self.docs:
            doc.done(self.words)
        met = [d.words for d in self.docs]
        words, at = np.unique(np.concatenate(met), return_inverse=True)
        times = np.bincount(at, np.concatenate([d.times for d in self.docs]), len(words)).astype(np.int64)
        flat, sizes = self.words.keys_of(words)
        keys, place = np.unique(flat, return_inverse=True)
        counts = np.bincount(place, np.repeat(times, sizes), len(keys)).astype(np.int64)
        ends, n = np.cumsum([len(m) for m in met]), len(self.docs)
        own = np.split(at.astype(np.int32), ends[:-1])
        column = lambda name, kind: pa.array([None, *[getattr(d, name) for d in self.docs]], kind)
        whole = lambda *data: [pa.array([d, *[None] * n], pa.binary()) for d in data]
        return pa.Table.from_arrays(
            [
                pa.array([number] * (n + 1), pa.int64()), *[column(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")], column("hash", pa.string()),
                pa.array([None, *map(packed, own)], pa.binary()), pa.array([None, *[packed(d.times) for d in self.docs]], pa.binary()),
                *whole(packed(keys), packed(counts), packed(sizes), packed(place.astype(np.int32))),
            ],
            names=[*DOCUMENT, "keys", "counts", "sizes", "places"],
        )


DOCUMENT = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "words", "times"]
_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, words binary, times binary, keys binary, counts binary, sizes binary, places binary"


def _blocks(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon(byte_path, piece_path)
        words.clear()
        block, number = Block(words), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if block.chars >= BLOCK_CHARS:
                    yield from block.rows(number).to_batches()
                    block, number = Block(words), number + 1
                    if words.chars >= KEPT_CHARS:
                        words.clear()
        if block.docs:
            yield from block.rows(number).to_batches()
        words.clear()

    return lean(run)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's blocks, merged while they fit."""
    keys, counts = [], []
    for batch in batches:
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(unpacked(k, np.int64))
            counts.append(unpacked(n, np.int64))
            if sum(map(len, keys)) > MERGED:
                which, sums = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [which], [sums]
                if len(which) > MERGED // 2:
                    yield pa.record_batch([pa.array(which), pa.array(sums)], ["key", "n"])
                    keys, counts = [], []
    if keys:
        which, sums = summed(np.concatenate(keys), np.concatenate(counts))
        yield pa.record_batch([pa.array(which), pa.array(sums)], ["key", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n) rows with the counts of a run of equal keys added up, as chunks of the shard that the task is."""
    shard, last, total, chunk = TaskContext.get().partitionId(), None, 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def emitted() -> pa.RecordBatch:
        k, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([int(k[0])], pa.int64()), pa.array([packed(k)]), pa.array([packed(n)])], ["shard", "chunk", "first", "keys", "counts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        if last is not None and keys[0] == last:
            counts[0] += total
        elif last is not None:
            held.append((np.array([last]), np.array([total])))
        last, total = int(keys[-1]), int(counts[-1])
        held.append((keys[:-1], counts[:-1]))
        if sum(len(h[0]) for h in held) >= CHUNK:
            yield emitted()
            chunk += 1
    if last is not None:
        held.append((np.array([last]), np.array([total])))
        yield emitted()


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id of B and the highest count of its pairs in a task."""
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b, n = np.append(ids, unpacked(k, np.int64) & _LOW), np.append(counts, unpacked(n, np.int64))
            order = np.lexsort((-n, b))
            top = order[np.append(True, b[order][1:] != b[order][:-1])]
            ids, counts = b[top], n[top]
    yield pa.record_batch([pa.array(ids), pa.array(counts)], ["b", "n"])


def _asking(shards: list[int], first: np.ndarray, salts: int):
    """What each block asks of each shard: the part of its sorted keys that lies in the shard's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = unpacked(data, np.int64)
                cuts = np.append(np.searchsorted(keys, first), len(keys))
                salt = (block * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % salts
                rows = [(shards[s], salt, block, keys[cuts[s] : cuts[s + 1]]) for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]
                if rows:
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([packed(r[3]) for r in rows]), pa.array([None] * len(rows), pa.binary())], ["shard", "salt", "kind", "place", "keys", "counts"])

    return run


class Mapped:
    """A shard's sorted keys and counts in a file of the task's own, mapped into memory."""

    def __init__(self):
        self.files = [tempfile.TemporaryFile(), tempfile.TemporaryFile()]
        self.keys = self.counts = None

    def append(self, keys: np.ndarray, counts: np.ndarray) -> None:
        for f, values in zip(self.files, (keys, counts), strict=True):
            f.write(values.tobytes())

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        if self.keys is None:
            for f in self.files:
                f.flush()
            self.keys, self.counts = (np.memmap(f, np.int64, "r") for f in self.files)
        at = np.searchsorted(self.keys, keys)
        if not np.array_equal(self.keys[at], keys):
            raise RuntimeError("a block asks for a pair that was not counted")
        return np.asarray(self.counts[at])

    def close(self) -> None:
        self.keys = self.counts = None
        for f in self.files:
            f.close()


def _answers(best: np.ndarray):
    """Rows sorted by shard, salt and kind: a shard's chunks, then the questions to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["shard"], row["salt"]) != at:
                        if shard:
                            shard.close()
                        at, shard = (row["shard"], row["salt"]), Mapped()
                    keys = unpacked(row["keys"], np.int64)
                    if row["kind"] == 0:
                        shard.append(keys, unpacked(row["counts"], np.int64))
                        continue
                    counts = shard.lookup(keys)
                    top = np.packbits(counts == best[keys & _LOW])
                    yield pa.record_batch([pa.array([row["place"]], pa.int64()), pa.array([row["shard"]], pa.int32()), pa.array([packed(counts)]), pa.array([top.tobytes()]), pa.array([len(keys)], pa.int64())], ["block", "shard", "counts", "best", "n"])
        finally:
            if shard:
                shard.close()

    return lean(run)


def _totals(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links."""
    answers = answers.sort_by("shard")
    of = lambda name, kind: [unpacked(d, kind) for d in answers.column(name).to_pylist()]
    none = np.zeros(0, np.int64)
    counts = np.concatenate(of("counts", np.int64)) if len(answers) else none
    best = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=n) for d, n in zip(answers.column("best").to_pylist(), answers.column("n").to_pylist(), strict=True)]) if len(answers) else none
    is_block = docs.column("doc_words").is_null()
    block, docs = docs.filter(is_block), docs.filter(pc.invert(is_block))
    sizes, places = (unpacked(block.column(c)[0].as_py(), kind) for c, kind in (("sizes", np.int64), ("places", np.int32)))
    ends = np.cumsum(sizes)
    # Sums over the links of each word, by differences of running sums; every word has one link at least.
    word = lambda v: np.add.reduceat(v[places].astype(np.int64), ends - sizes) if len(places) else none
    per_count, per_best = word(counts), word(best)
    sums, tops = [], []
    for words, times in zip(docs.column("doc_words").to_pylist(), docs.column("times").to_pylist(), strict=True):
        w, n = unpacked(words, np.int32), unpacked(times, np.int64)
        sums.append(int(per_count[w] @ n))
        tops.append(int(per_best[w] @ n))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    return out.append_column("n_links", docs.column("n_groups")).append_column("n_best", pa.array(tops, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Alignment:
    """The written tables of an aligned corpus: ``blocks`` and ``counts`` (shards of sorted pair keys)."""

    def __init__(self, docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"):
        bounded_batches(docs.sparkSession)
        texts = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
        self.blocks, _ = written(texts.mapInArrow(_blocks(byte_path, piece_path), _SCHEMA))
        partial, _ = written(self.blocks.filter("keys IS NOT NULL").select("keys", "counts").mapInArrow(_partial, "key long, n long"))
        shards = max(1, -(-partial.count() // SHARD_KEYS))
        ranged = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
        self.counts, _ = written(ranged.mapInArrow(_summed, "shard int, chunk int, first long, keys binary, counts binary"))

    def pair_counts(self) -> DataFrame:
        """a, b, n: how often tokens of these ids end together in the corpus."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys = unpacked(k, np.int64)
                    yield pa.record_batch([pa.array(keys >> 32), pa.array(keys & _LOW), pa.array(unpacked(n, np.int64))], ["a", "b", "n"])

        return self.counts.select("keys", "counts").mapInArrow(run, "a long, b long, n long")

    def documents(self) -> DataFrame:
        """A row for each document with the sums over its links."""
        # One number for each id of B: bounded by its vocabulary.
        top = self.counts.select("keys", "counts").mapInArrow(_highest, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).collect()
        best = np.full(max((r["b"] for r in top), default=0) + 1, -1, np.int64)
        for r in top:
            best[r["b"]] = r["n"]
        # Two numbers for each shard of a million keys: bounded by the product of the vocabularies.
        shards = sorted((r["shard"], r["first"]) for r in self.counts.groupBy("shard").agg(F.min("first").alias("first")).collect())
        held = self.blocks.filter("keys IS NOT NULL")
        salts = max(1, -(-held.count() // ASKED_BLOCKS))
        asking = held.select("block", "keys").mapInArrow(_asking([s for s, _ in shards], np.array([f for _, f in shards], np.int64), salts), "shard int, salt int, kind int, place long, keys binary, counts binary")
        chunks = self.counts.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("chunk").cast("long").alias("place"), "keys", "counts")
        both = asking.unionByName(chunks).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "place")
        answers = both.mapInArrow(_answers(best), "block long, shard int, counts binary, best binary, n long")
        docs = self.blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.col("words").alias("doc_words"), "times", "sizes", "places")
        return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_totals, RESULT)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    return Alignment(docs, byte_path, piece_path, id_col, text_col).documents()
