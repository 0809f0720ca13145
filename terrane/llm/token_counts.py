"""Token counts by prefix dynamic programming: the exact count at every prefix, without encoding any prefix again.

For merge-based vocabularies the encoding of a prefix is the encoding of a shorter prefix plus one last token, and a
token t may follow a last token s exactly if the pair encodes as [s, t]. So one pass finds for every prefix its last
token and its count. No piece of the model spans a space or a line end, so the pass starts anew at each such place and
its results are kept by word: a text's counts are a running sum over its words plus the table of one word.

Defined results: a null text counts as empty (0 tokens); empty text 0; white space alone is counted as the library
does; equal texts give equal rows; duplicate ids give a row each; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.piece_model import BPE, NORMAL, SPACE, PieceModel
from terrane.llm.text import bytes_of

#: Words whose counts, and pairs of pieces whose fit, a worker keeps; beyond it they are dropped and found anew. Bounds memory, changes no result.
KEPT_WORDS, KEPT_PAIRS = 1_000_000, 1_000_000
_CHUNK = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class PrefixCounter:
    """Counts of a byte-fallback merge vocabulary at every prefix of a text."""

    def __init__(self, model: PieceModel):
        model.check_plain()
        if model.algorithm != BPE or not model.byte_fallback:
            raise ValueError("prefix counts are built for merge vocabularies with byte fallback")
        normal = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL]
        scores = dict(zip(model.pieces, model.scores, strict=True))
        self.rank = {p: i for i, p in enumerate(sorted(normal, key=lambda p: -scores[p]))}
        if any("\n" in p for p in self.rank):
            raise ValueError("pieces across line ends are not rebuilt")
        # How each piece comes about: the two parts of its last merge. Pieces that merging never makes are left out.
        self.parts = {p: self.merged(p)[1] for p in self.rank}
        self.rank = {p: i for p, i in self.rank.items() if len(p) == 1 or self.parts[p]}
        self.ends = {p[i:] for p in self.rank for i in range(len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by merging (best rank first, then leftmost), and the last merge if one is left."""
        rank, pieces, last = self.rank, list(text), None
        while True:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                r = rank.get(pieces[i] + pieces[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return pieces, last if len(pieces) == 1 else None
            last = pieces[at], pieces[at + 1]
            pieces[at : at + 2] = [last[0] + last[1]]

    def _fit(self, left: str, right: str) -> bool:
        """Whether two pieces side by side stay apart: no merge across comes before the merges that make them.

        Merges are undone in reverse order, on the side made last, and the pair at the border is looked up each time. Of
        equal merges the leftmost comes first, so a merge across beats an equal one on its right but not on its left.
        """
        rank, parts = self.rank, self.parts
        if left not in rank or right not in rank:
            return True
        before = len(rank) * 2
        while True:
            across = rank.get(left + right)
            if across is not None and across < before:
                return False
            undo_left, undo_right = parts[left], parts[right]
            if undo_left and (not undo_right or rank[left] > rank[right]):
                before, left = rank[left], undo_left[1]
            elif undo_right:
                before, right = rank[right] + 1, undo_right[0]
            else:
                return True

    def table(self, word: str) -> list[int]:
        """counts[i] = tokens of word[:i], for i from 0 to the word's length."""
        rank, ends, fits = self.rank, self.ends, self.fits
        counts, lasts = [0], [""]
        for end in range(1, len(word) + 1):
            found, start = [], end - 1
            token = word[start]
            while token in ends:
                if token in rank:
                    found.append((start, token))
                if not start:
                    break
                start -= 1
                token = word[start:end]
            for start, token in reversed(found):
                if not start:
                    break
                key = (lasts[start], token)
                fit = fits.get(key)
                if fit is None:
                    fit = fits[key] = self._fit(*key)
                if fit:
                    break
            else:
                # A character without a piece: as many tokens as it has bytes, and nothing merges with it.
                lasts.append(word[end - 1])
                counts.append(counts[-1] + len(word[end - 1].encode()))
                continue
            lasts.append(token)
            counts.append(counts[start] + 1)
        if len(fits) > KEPT_PAIRS:
            fits.clear()
        return counts

    def total(self, word: str) -> int:
        """Tokens of one word, kept."""
        n = self.totals.get(word)
        if n is None:
            if len(self.totals) >= KEPT_WORDS:
                self.totals.clear()
            n = self.totals[word] = self.table(word)[-1]
        return n

    def words(self, text: str) -> list[str]:
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        get, total = self.totals.get, 0
        words = self.words(text)
        for word, n in zip(words, map(get, words), strict=True):
            total += self.total(word) if n is None else n
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of text[:i] for i from 0 to its length."""
        out, base = [0], 0
        for k, word in enumerate(self.words(text)):
            table = self.table(word)
            # The marker before the first character belongs to the prefix that holds that character.
            out.extend(base + n for n in (table[2:] if k == 0 else table[1:]))
            base += table[-1]
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens (counts may fall as a word grows, so it is the last that fits)."""
        base, at, best = 0, 0, 0
        for k, word in enumerate(self.words(text)):
            n = self.total(word)
            skip = 1 if k == 0 else 0
            if base + n <= budget:
                best = at + len(word) - skip
            else:
                table = self.table(word)
                fit = [i for i in range(1 + skip, len(word) + 1) if base + table[i] <= budget]
                if fit:
                    best = at + fit[-1] - skip
                if base > budget:
                    break
            base, at = base + n, at + len(word) - skip
        return text[:best]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter a worker process and model."""
    return PrefixCounter(PieceModel.parse(path))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, by one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in batches:
            _, offsets = bytes_of(batch.column(1))
            tokens = pa.array([count.count(t) if t else 0 for t in (x.as_py() for x in batch.column(1))], pa.int64())
            over = pa.array(np.asarray(tokens) > limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), tokens, over], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncate_to_budget(docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the longest prefix of each text that has at most ``budget`` tokens (null text: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in batches:
            cut = [None if t is None else count.truncate(t, budget) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=[id_col, text_col])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, rows.schema)
