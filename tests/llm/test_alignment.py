"""Alignment of two tokenizers against a plain version over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, {i: t for t, i in a.get_vocab().items()}, alignment.byte_table()


def plain(texts):
    """Tokens, groups and links of each text by comparing all pairs of ends."""
    a, b, entry, byte = libraries()
    rows, links = [], []
    for text in texts:
        one, two = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        first = [bytes(byte[c] for c in entry[i]) for i in one]
        second = [bytes([b.id_to_piece(i).startswith("<0x") and int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
        if not text or b"".join(first) != f" {text}".encode() or b"".join(second) != f" {text}".encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in first]).tolist(), np.cumsum([len(t) for t in second]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [(",".join(str(i) for i, e in zip(one, ends_a, strict=True) if low < e <= high), ",".join(str(i) for i, e in zip(two, ends_b, strict=True) if low < e <= high)) for low, high in zip([0, *cuts], cuts, strict=False)]
        rows.append((len(one), len(two), len(groups), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
        links.append([(one[ends_a.index(c)], two[ends_b.index(c)]) for c in cuts])
    count = Counter(pair for own in links for pair in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(*r[:3], len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), r[3]) for r, own in zip(rows, links, strict=True)]


def result(frame):
    return [tuple(r) for r in frame.orderBy("doc_id").collect()]


TEXTS = [None, "", " ", "  ", "a", "hello world", "hello  world ", " two\n\n  lines\t and 'tis they're", "<|endoftext|> <s> </s>", "café naïve 日本語 \U0001f600", "a▁b", " x y ​ z", "nul\0 byte", "\r\n \r\n x", "x" * 3000, "word " * 5000, "hello world", "12345 678,90 ٠١", "﻿mark  \x1c \x85 end"]


@pytest.mark.parametrize("small", [False, True])
def test_equals_the_plain_version(spark, monkeypatch, small):
    if small:  # many blocks, shards and copies of shards, on the driver's side; workers keep their sizes
        monkeypatch.setattr(alignment, "SHARD_KEYS", 20)
        monkeypatch.setattr(alignment, "ASKED_BLOCKS", 1)
    rows = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id int, text string, block string").repartition(3, "doc_id")
    assert result(alignment.align_documents(rows, A, B)) == [(i, *r) for i, r in enumerate(plain(TEXTS))]


def test_pair_counts_are_the_links_of_the_corpus(spark):
    texts = [t for t in TEXTS if t]
    found = alignment.Alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B)
    assert found.pair_counts().agg(F.sum("n")).first()[0] == sum(r[3] for r in plain(texts))
    assert found.pair_counts().groupBy("a", "b").count().filter("count > 1").isEmpty()


def test_repeated_rows_nulls_and_an_empty_table(spark):
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align_documents(rows, A, B).collect()), key=str)
    want = plain(["one two", "one two", "one", None])
    assert got == sorted([(1, *want[0]), (1, *want[1]), (None, *want[2]), (2, *want[3])], key=str)
    assert alignment.align_documents(rows.limit(0), A, B).collect() == []


def test_small_blocks_give_the_same(monkeypatch):
    monkeypatch.setattr(alignment, "RUN_CHARS", 7)
    block = alignment.Block(alignment.Lexicon(alignment.Pair(A, B)))
    for i, t in enumerate(TEXTS):
        block.add(i, t)
    block.rows(0)
    assert [(d.n_a, d.n_b, d.n_groups, d.hash) for d in block.docs] == [(r[0], r[1], r[2], r[6]) for r in plain(TEXTS)]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.sampled_from(" \n\t\rabt'sD1.é  ▁​\x1c\x85日\U0001f600"), max_size=30), min_size=1, max_size=4))
def test_words_add_up_to_their_texts(texts):
    pair = test_words_add_up_to_their_texts.__dict__.setdefault("pair", alignment.Pair(A, B))
    block = alignment.Block(alignment.Lexicon(pair))
    for i, t in enumerate(texts):
        block.add(i, t)
    block.rows(0)
    assert [(d.n_a, d.n_b, d.n_groups, d.hash) for d in block.docs] == [(r[0], r[1], r[2], r[6]) for r in plain(texts)]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 5)), max_size=40))
def test_sums_and_packing(pairs):
    keys, counts = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    which, sums = alignment.summed(keys, counts)
    want = Counter()
    for k, n in pairs:
        want[k] += n
    assert dict(zip(which.tolist(), sums.tolist(), strict=True)) == dict(want) and which.tolist() == sorted(want)
    assert alignment.unpacked(alignment.packed(keys), np.int64).tolist() == keys.tolist()
