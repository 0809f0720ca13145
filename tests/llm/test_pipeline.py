from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from terrane.llm import registry

SF = Path("/root/testdata/sf0.001")


def views():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        p = SF / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    got, want = registry.queries()[name](spark, str(SF)).toPandas(), views().execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    order = lambda f: f[columns].sort_values(columns).reset_index(drop=True).astype(str)
    pd.testing.assert_frame_equal(order(got), order(want))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_return_whole_tables(spark, name):
    rows = registry.queries()[name](spark, str(SF))
    n = rows.count()
    assert n > 0
    if name not in ("op4_exact_top_k", "op7_url_filters", "op8_packing", "pipeline"):
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name == "n-gram Jaccard join":
            kept, all_ = {r.doc_id for r in docs.collect()}, before.collect()
            sets = {r.doc_id: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())] for i in range(max(1, len(w) - 4))} for r in all_ if r.text.isascii()}
            for a in sets:
                linked = [b for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
                assert a not in kept if linked else True
        assert docs.count() > 0
    assert docs.agg({"length": "sum"}).first()[0] == docs.dropDuplicates(["doc_id"]).agg({"doc_tokens": "sum"}).first()[0]
    assert corpus_pipeline.ORACLE_SQL is None
