from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from terrane.llm import language, quality
from terrane.llm.text import bytes_of


SF = "/root/testdata/sf0.01"
EDGES = [(900000, None), (900001, ""), (900002, "  \n"), (900003, "12 34 ..."), (900004, "é"), (900005, "x" * 400_000)]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_features_of_a_repeated_word():
    data, offsets = bytes_of(pa.array(["ab ab ab", "", "ab cd!"]))
    row, index, value = quality.features(data, offsets)
    assert set(row.tolist()) == {0, 2}
    for r, streams in ((0, 3), (2, 3)):
        assert np.isclose(value[row == r].sum(), streams * quality.SCALE)
    pairs = quality.gathered(row, index, value, 3)
    assert len(pairs[1][0]) == 0 and len(pairs[0][0]) == 3


def test_updates_learn_a_plain_rule():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 300)
    rows = [(np.array([int(y), 5 + int(rng.integers(0, 40))]), np.array([3.0, 3.0])) for y in labels]
    weights, bias = quality.follow_the_leader(rows, labels)
    assert weights[1] > 0 > weights[0]
    model = quality.Model(weights, bias)
    assert model.score(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape == (1,)


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score_labelled_documents(docs, labels).toPandas()
    known = got.merge(labels.toPandas(), on="doc_id")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [fold(i, 5) == 0 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    held = known[known["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.93
    assert held[held["quality"] == 1]["predicted"].mean() >= 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in [*EDGES, *EDGES[:2]]], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(900001, 1), (900002, None)], "doc_id long, quality int")
    got = quality.score_labelled_documents(docs, labels).toPandas()
    assert len(got) == len(EDGES) + 2 and got["score"].nunique() == 1
    none = quality.score_labelled_documents(docs, labels.filter("false")).toPandas()
    assert (none["score"] == 0.5).all()
    assert quality.score_labelled_documents(docs.filter("false"), labels).collect() == []


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify_documents(docs).toPandas()
    known = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = known[known["held_out"] & known["lang"].notna()]
    assert len(got) == docs.count() and (held["lang_pred"] == held["lang"]).mean() >= 0.97
    assert (got["held_out"] == [fold(i, 4) == 2 for i in got["doc_id"]]).all()


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(i, t, None) for i, t in EDGES], docs.schema)
    got = {r.doc_id: r for r in language.identify_documents(docs.unionAll(odd)).collect()}
    assert [got[i].lang_pred == "und" for i, _ in EDGES] == [True, True, True, True, False, False]
    assert got[900000].score == 0
    nothing = language.identify_documents(odd).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify_documents(odd.filter("false")).collect() == []


def test_tables_agree_with_the_network():
    rng = np.random.default_rng(2)
    net = language.fit([bytes(rng.integers(97, 105, 300).astype(np.uint8)) if k % 2 else bytes(rng.integers(105, 113, 300).astype(np.uint8)) for k in range(60)], [str(k % 2) for k in range(60)])
    texts = ["".join(map(chr, rng.integers(97, 105, 700))), "".join(map(chr, rng.integers(105, 113, 20)))]
    pick, score = net.predict(*bytes_of(pa.array(texts)))
    assert [net.names[p] for p in pick] == ["1", "0"] and (score > 0.6).all()
    long, _ = net.predict(*bytes_of(pa.array(["".join(map(chr, rng.integers(97, 105, 3 << 20)))])))
    assert net.names[long[0]] == "1"


def test_kept_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    told = language.keep_known(docs, language.train(docs))
    assert told.schema == docs.schema and told.count() >= docs.count() - 5
    assert isinstance(kept.limit(1).toPandas(), pd.DataFrame)
