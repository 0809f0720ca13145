from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import text as X

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x0cé日.,", max_size=40)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_words_and_hashes(texts):
    column = pa.array(["drop", *texts], pa.string()).slice(1)
    data, offsets = X.bytes_of(column)
    starts, ends, words = X.word_spans(data, offsets)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    got = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(words[:-1], words[1:], strict=True)]
    assert got == want
    hashes = X.word_hashes(data, starts, ends).tolist()
    flat = [w for row in want for w in row]
    assert len({*zip(flat, hashes, strict=True)}) == len(set(flat)) == len(set(hashes))


@settings(deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_grams_stay_inside_texts(texts, n):
    data, offsets = X.bytes_of(pa.array(texts, pa.string()))
    starts, ends, words = X.word_spans(data, offsets)
    owner = X.gram_owner(words, n)
    counts = np.diff(words)
    assert sorted(owner[owner >= 0].tolist()) == [i for i, c in enumerate(counts) for _ in range(max(0, c - n + 1))]
    assert len(X.gram_hashes(X.word_hashes(data, starts, ends), n)) == len(owner)


def test_slices_hold_whole_texts():
    data, offsets = X.bytes_of(pa.array(["aaaa", "", "b" * 50, None, "cc"]))
    parts = list(X.slices(data, offsets, 10))
    assert [p[:2] for p in parts][0][0] == 0 and parts[-1][1] == 5
    assert b"".join(p[2].tobytes() for p in parts) == data.tobytes()


def test_empty_and_null_columns():
    for column in (pa.array([], pa.string()), pa.nulls(3), pa.array(["", None], pa.large_string()), pa.chunked_array([["a"], ["b", None]])):
        data, offsets = X.bytes_of(column)
        assert len(offsets) == len(column) + 1 and offsets[-1] == len(data)
