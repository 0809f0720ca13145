"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model file alone.

``build`` makes the whole tokenizer: space marker before the text and for spaces, merge or unigram model with byte
fallback, and the decoder that undoes them. Corpus encoding runs it over the distinct words of each batch (no piece
spans a space, so words are independent) with the library's threads, and puts texts together from kept ids. Each
distinct word is also encoded by the sentencepiece library, and its ids are decoded and compared with the word.

Defined results: null and empty texts have no ids (n_ids 0, crc of no bytes, round_trip and parity true); the marker
character inside a text counts as a space, as in the library, so such a text does not round trip.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from terrane.llm.piece_model import BPE, BYTE, CONTROL, NORMAL, SPACE, UNIGRAM, PieceModel

#: Words whose ids a worker keeps; beyond it they are dropped and encoded anew.
KEPT_WORDS = 300_000
#: Characters of text encoded at a time.
BLOCK_CHARS = 1 << 22
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def model_of(model: PieceModel) -> models.Model:
    ids = {p: i for i, p in enumerate(model.pieces)}
    if model.algorithm == UNIGRAM:
        return models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=model.unknown, byte_fallback=model.byte_fallback)
    if model.algorithm != BPE:
        raise ValueError("only merge and unigram models are rebuilt")
    normal = {p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL}
    order = sorted(normal, key=lambda p: (-model.scores[ids[p]], ids[p]))
    merges = [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in normal and p[i:] in normal]
    return models.BPE(vocab=ids, merges=merges, unk_token=model.pieces[model.unknown], fuse_unk=not model.byte_fallback, byte_fallback=model.byte_fallback)


def build(model: PieceModel, whole: bool = True) -> Tokenizer:
    """The tokenizer for whole texts, or (whole=False) for single words that carry their marker already."""
    model.check_plain()
    out = Tokenizer(model_of(model))
    if whole:
        out.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+$"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return out


class Codec:
    def __init__(self, path: str, check: bool = True):
        self.model = PieceModel.parse(path)
        self.words = build(self.model, whole=False)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if check else None
        self.units = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = [0]
        self.sound: list[bool] = []
        self.same: list[bool] = []

    def learn(self, fresh: list[str]) -> None:
        """Encodes words that are not known yet, all at once, with the library's threads."""
        got = [e.ids for e in self.words.encode_batch_fast(fresh, add_special_tokens=False)]
        total = self.ends[-1] + sum(map(len, got))
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.ends[-1]], np.zeros(max(total, len(self.ids)), np.uint32)])
        # The library puts a marker before each text, so a word goes to it without its first one.
        other = self.library.encode([w[1:].replace(SPACE, " ") for w in fresh], num_threads=1) if self.library else got
        units = self.units
        for word, ids, theirs in zip(fresh, got, other, strict=True):
            self.known[word] = len(self.sound)
            self.ids[self.ends[-1] : self.ends[-1] + len(ids)] = ids
            self.ends.append(self.ends[-1] + len(ids))
            self.sound.append(b"".join([units[i] for i in ids]) == word.encode())
            # A bare first marker is a word here, but the library gives nothing for an empty text.
            self.same.append(ids == theirs or word == SPACE)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """For each text its ids, whether they decode to it, and whether the sentencepiece library gives the same."""
        if len(self.known) > KEPT_WORDS:
            self.clear()
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        if fresh := [w for w in dict.fromkeys(w for words in split for w in words) if w not in known]:
            self.learn(fresh)
        ends, sound, same = np.array(self.ends), np.array(self.sound, bool), np.array(self.same, bool)
        out = []
        for text, words in zip(texts, split, strict=True):
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            first, sizes = ends[at], ends[at + 1] - ends[at]
            steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out.append((self.ids[np.repeat(first, sizes) + steps], bool(sound[at].all()) and SPACE not in text, bool(same[at].all())))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes laid end to end, markers as spaces, without the first."""
        text = b"".join(self.units[i] for i in ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), round_trip, parity; with keep_ids also the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in batches:
            rows = [r for part in blocks([t or "" for t in batch.column(1).to_pylist()]) for r in coder.encode(part)]
            columns = [batch.column(0), pa.array([len(i) for i, _, _ in rows], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i, _, _ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.bool_()), pa.array([p for _, _, p in rows], pa.bool_())]
            if keep_ids:
                columns.append(pa.array([i.astype(np.int32) for i, _, _ in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "n_ids", "ids_crc32", "round_trip", "parity"] + ["ids"] * keep_ids
    return rows.mapInArrow(run, f"{id_col} {kind}, n_ids long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * keep_ids)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each list of ids (null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, text string")
