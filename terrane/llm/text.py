"""Array kernels over batches of texts: words, word hashes and word n-gram hashes without a Python loop per word.

All functions take the bytes of many texts laid end to end and the offsets that separate them, as Arrow stores a
string column, so a batch costs a few passes of numpy over its bytes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the kernels works on; bounds their temporary arrays (about 60 bytes a byte).
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240611)
_SEEDS = _rng.integers(1, 2**63, 2, dtype=np.uint64)
_GRAM = int(_rng.integers(2**61, 2**63)) * 2 + 1
#: Bytes of a word whose codes are looked up in a table; those further on are computed alike.
_TABLED = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@functools.lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trimmed() -> None:
    """Gives freed memory back: workers live on, and what they keep counts against the executor's next stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives freed memory back when its partition is done."""

    @functools.wraps(run)
    def over(batches: Iterator) -> Iterator:
        yield from run(batches)
        trimmed()

    return over


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def _codes(which: int) -> np.ndarray:
    """The codes of the bytes 0 .. 255 at the first places of a word, a row for each place."""
    return _code(np.arange(_TABLED << 8, dtype=np.uint64), which).reshape(_TABLED, 256)


def _code(place_and_byte: np.ndarray, which: int) -> np.ndarray:
    return mix(mix(place_and_byte + _SEEDS[which]) ^ _SEEDS[1 - which])


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes (one text if it is longer): first row, end row, bytes, offsets."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(max(at + 1, np.searchsorted(offsets, offsets[at] + size, "right") - 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: first byte, end byte, and the n + 1 offsets of the texts in words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[offsets < n]] = False
    after[offsets[offsets > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``which`` (0 or 1) chooses one of two that are independent of one another.

    Every (place, byte) has a code of its own from a mixing function, and a word's codes are summed. No power of a base
    is in it, so words built from one another (such as complementary Thue-Morse words) are as far apart as any.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    codes, sums = _codes(which), lengths.astype(np.uint64)
    # Place by place over the words that reach it; what long words hold beyond the table, byte by byte.
    left, at, total = np.arange(len(starts)), starts, sums.copy()
    for place in range(_TABLED):
        total += codes[place][data[at]]
        more = np.flatnonzero(lengths[left] > place + 1)
        if len(more) < len(left):
            sums[left] = total
            left, at, total = left[more], at[more], total[more]
        if not len(left):
            return mix(sums)
        at = at + 1
    rest = lengths[left] - _TABLED
    first = np.cumsum(rest) - rest
    place = np.arange(int(rest.sum())) - np.repeat(first, rest)
    byte = data[place + np.repeat(at, rest)]
    far = _code(((place + _TABLED) << 8 | byte).astype(np.uint64), which)
    sums[left] = total + np.add.reduceat(far, first)
    return mix(sums)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive words, at the index of its first word (the last n - 1 lack one)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    count, total = len(words) - n + 1, np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(_GRAM) + words[j : j + count]
    return mix(total)


def gram_owner(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """For each run of n consecutive words its text's row, or -1 if it spans two texts."""
    counts = np.diff(word_offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < n:
        return np.zeros(0, np.int64)
    first, last = owner[: len(owner) - n + 1], owner[n - 1 :]
    return np.where(first == last, first, -1)


def crowded(keys: np.ndarray, most: int) -> np.ndarray:
    """A weight for each row of a task by its key: 1, but of a key with more than ``most`` rows one row has their number
    and the others 0. So a key that very many rows share sends one row a task to the place where its rows meet."""
    weight = np.ones(len(keys), np.int32)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    for at, n in zip(first[size > most].tolist(), size[size > most].tolist(), strict=True):
        weight[order[at : at + n]] = 0
        weight[order[at]] = n
    return weight
