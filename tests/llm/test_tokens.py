from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrane.llm import packing
from terrane.llm.piece_model import PieceModel
from terrane.llm.sentencepiece_codec import build, codec, decode_documents, encode_documents
from terrane.llm.token_counts import counter, token_counts, truncate_to_budget

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
ODD = ["", " ", "  ", "\n", "a\n b", "  a  b <s> \n\tx  ", "　Ａﬁ é", "日本語 テキスト 🎉🎉", "x" * 3000, "a▁b", "\x00a", "aa bb \r\n\r\n c", "é" * 50 + " ß", "don't  'll x's", "a <|endoftext|> b", "x\x1c y", "a  b", "99 a1b2"]
TEXT = st.text(alphabet="abeth nsr\n.,'é日▁🎉0", max_size=30)


@settings(deadline=None, max_examples=200)
@given(TEXT)
def test_prefix_counts(text):
    assert counter(PIECES).prefixes(text).tolist() == [len(LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter(PIECES).count(text) == len(LIBRARY.encode(text))


@settings(deadline=None, max_examples=100)
@given(TEXT, st.integers(0, 12))
def test_longest_prefix_within_budget(text, budget):
    want = max(i for i in range(len(text) + 1) if len(LIBRARY.encode(text[:i])) <= budget)
    assert counter(PIECES).truncate(text, budget) == text[:want]


def test_undoing_merges_agrees_with_merging():
    c = counter(PIECES)
    c.count(" ".join(ODD) + " the quick brown foxes unbelievably re-read straightforward internationalisation")
    for left, right in list(c.fits):
        if left in c.rank and right in c.rank:
            assert c.fits[left, right] == (c.merged(left + right)[0] == [left, right])


def test_count_query(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, ODD[4]])], "doc_id long, text string").withColumnRenamed("x", "y").selectExpr("*", "1 AS n_tokens", "text AS n_bytes")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PIECES, 1000).collect()}
    for i, t in enumerate([*ODD, "", ODD[4]]):
        n = len(LIBRARY.encode(t))
        assert got[i] == (len(t.encode()), n, n > 1000)
    assert token_counts(docs.filter("false"), PIECES).collect() == []
    cut = {r.doc_id: r.text for r in truncate_to_budget(docs, PIECES, 3).collect()}
    assert cut[len(ODD)] is None and all(len(LIBRARY.encode(v)) <= 3 for v in cut.values() if v)


@settings(deadline=None, max_examples=100)
@given(st.lists(TEXT, max_size=5))
def test_codec_parity_and_round_trip(texts):
    for text, (ids, sound, same) in zip(texts, codec(PIECES).encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text) and same
        assert sound == ("▁" not in text)
        if sound:
            assert codec(PIECES).decode(ids.tolist()) == text


def test_whole_tokenizer():
    whole = build(PieceModel.parse(PIECES))
    for text in ODD:
        assert whole.encode(text, add_special_tokens=False).ids == LIBRARY.encode(text)
        if "▁" not in text and "\x00" not in text:
            assert whole.decode(LIBRARY.encode(text)) == text


def unigram_file(path):
    """A hand-written unigram model of a few pieces with byte fallback."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def piece(text, score, kind):
        body = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        return b"\x0a" + varint(len(body)) + body

    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)]]
    rows += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("▁a", -2.5), ("ab", -2.0), ("▁ab", -3.5), ("ba", -3.1), ("aba", -2.9)]]
    trainer = b"\x18\x01" + varint(35 << 3) + b"\x01"
    normaliser = b"\x0a\x08identity" + b"\x18\x01" + b"\x20\x00" + b"\x28\x01"
    data = b"".join(piece(*r) for r in rows) + b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normaliser)) + normaliser
    path.write_bytes(data)
    return str(path)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab é", max_size=14), max_size=4))
def test_unigram_models(tmp_path_factory, texts):
    where = tmp_path_factory.getbasetemp() / "unigram.model"
    path = str(where) if where.exists() else unigram_file(where)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text, (ids, sound, same) in zip(texts, codec(path).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text) and same and sound


def test_codec_queries(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    rows = encode_documents(docs, PIECES, keep_ids=True)
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate([*ODD, ""]):
        ids = LIBRARY.encode(t)
        assert (got[i].n_ids, got[i].ids_crc32, got[i].ids, got[i].parity) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids, True)
    texts = {r.doc_id: r.text for r in decode_documents(rows, PIECES).collect()}
    assert all(texts[i] == t for i, t in enumerate(ODD) if "▁" not in t)


def test_models_that_are_not_rebuilt():
    model = PieceModel.parse(PIECES)
    model.squeeze_spaces = True
    with pytest.raises(ValueError):
        build(model)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(TEXT, st.sampled_from(ODD)), max_size=5))
def test_byte_level_ids(texts):
    library = packing.encoder(BYTES).tokenizer
    assert [i.tolist() for i in packing.encoder(BYTES).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=6), st.integers(0, 80))
def test_fullest_against_all_sums(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    used = packing.fullest(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= capacity)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 3000), max_size=120))
def test_packer_keeps_every_token_once(lengths):
    out = []
    packer = packing.Packer(1024, 7, lambda piece, sequence, offset: out.append((*piece, sequence, offset)))
    for i, n in enumerate(lengths):
        packer.add((i, 0, n))
    packer.close()
    spans, fills = {}, {}
    for row, start, length, sequence, offset in out:
        spans.setdefault(row, []).append((start, length))
        fills.setdefault(sequence, []).append((offset, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == n
    for pieces in fills.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_packing_query(spark):
    texts = [*ODD, None, "word " * 4000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack_documents(docs, BYTES).collect()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in own) == len(ids) and {r.doc_tokens for r in rows if r.doc_id == i} == {len(ids)}
        assert all(crc == zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n])) for s, n, crc in own)
    assert packing.pack_documents(docs.filter("false"), BYTES).collect() == []
