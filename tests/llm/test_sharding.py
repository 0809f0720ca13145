"""Shards by weighted draws: the law, the weights, where rows move, and gapless slots."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.llm import sharding
from terrane.llm.sharding import Leaf, Tree


def plain(key, tree):
    """Descends by draws computed one at a time."""
    here = list(tree.leaves)
    for level in range(3):
        name = lambda leaf: "/".join([leaf.region, leaf.rack, str(leaf.shard)][: level + 1])  # noqa: E731, B023
        weights = Counter()
        for leaf in here:
            weights[name(leaf)] += leaf.weight
        draw = lambda n: math.log((int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[n]  # noqa: E731, B023
        best = max((n for n, w in weights.items() if w > 0), key=draw)
        here = [leaf for leaf in here if name(leaf) == best]
    return here[0].shard


def placed(spark, tree, n=4000):
    return {r["id"]: r["shard"] for r in sharding.place(spark.range(n), tree, "id").collect()}


TREE = Tree((Leaf("a", "x", 0, 1.0), Leaf("a", "x", 1, 2.0), Leaf("a", "y", 2, 1.0), Leaf("b", "x", 3, 0.5), Leaf("b", "z", 4, 3.5), Leaf("c", "q", 5, 0.0)))


def test_draws_equal_the_plain_ones_and_follow_weights(spark):
    got = placed(spark, TREE)
    assert all(plain(i, TREE) == s for i, s in list(got.items())[:500])
    share = Counter(got.values())
    for leaf in TREE.leaves:
        assert abs(share[leaf.shard] / 4000 - leaf.weight / 8) < 0.03
    assert 5 not in share


def test_a_shard_of_its_own_region_takes_rows_only_into_itself(spark):
    for n in (1, 5, 16):
        before, after = placed(spark, sharding.balanced(n)), placed(spark, sharding.balanced(n).grown(n))
        moved = {i for i in before if before[i] != after[i]}
        assert moved and all(after[i] == n for i in moved)
        assert abs(len(moved) / 4000 - 1 / (n + 1)) < 0.03


def test_rows_move_only_into_or_out_of_the_subtree_whose_weight_changes(spark):
    before = placed(spark, TREE)
    changed = lambda shard, w: Tree(tuple(Leaf(leaf.region, leaf.rack, leaf.shard, w if leaf.shard == shard else leaf.weight) for leaf in TREE.leaves))
    rack = {leaf.shard: (leaf.region, leaf.rack) for leaf in TREE.leaves}
    for w in (0.0, 5.0):
        after = placed(spark, changed(1, w))
        for i in before:
            if before[i] != after[i]:
                assert ("a", "x") in (rack[before[i]], rack[after[i]]) or {before[i], after[i]} & {2}  # within a: its racks' shares change
                assert "a" in (rack[before[i]][0], rack[after[i]][0])
        crossing = {(rack[before[i]][0], rack[after[i]][0]) for i in before if rack[before[i]][0] != rack[after[i]][0]}
        assert crossing == ({("b", "a")} if w else {("a", "b")})
    # Below region b all weights stay: no row moves within it.
    after = placed(spark, changed(0, 9.0))
    assert all(before[i] == after[i] for i in before if rack[after[i]][0] == "b")


def test_digest_of_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (None, ""), (None, "é" * 3), (2, "x" * 200_000), *[(7, f"t{i}") for i in range(300)]]
    docs = spark.createDataFrame([(*r, 9, "slot") for r in rows], "doc_id long, text string, shard int, slot string").repartition(4)
    got = sharding.shard_documents(docs, 6).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain("" if i is None else i, sharding.balanced(6))) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    assert {r["law"] for r in got} == {"key"} and all(r["grown_shard"] in (r["shard"], 6) for r in got)
    for shard in {r["shard"] for r in got}:
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in own]
        assert order == sorted(order)
    assert sharding.shard_documents(docs.limit(0), 6).collect() == []


def test_slots_with_many_files_a_shard_and_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_RUNS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 40)
    try:
        rows = spark.range(3000).select(F.lit(0).alias("g"), (F.col("id") % 3).alias("k"), "id")
        got = sharding.numbered(rows, "g", ["k", "id"]).orderBy("slot").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["slot"] for r in got] == list(range(3000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 3, i) for i in range(3000))


def test_written_shards_hold_their_rows_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    rows = docs.join(sharding.shard_documents(docs, 3).select("doc_id", "shard", "slot"), "doc_id")
    sharding.write_shards(rows, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in back.collect()) == sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows.collect())


def test_what_trees_refuse():
    with pytest.raises(ValueError, match="twice"):
        Tree((Leaf("a", "b", 0), Leaf("c", "d", 0)))
    with pytest.raises(ValueError, match="weights"):
        Tree((Leaf("a", "b", 0, 0.0),))
    with pytest.raises(ValueError, match="weights"):
        Tree((Leaf("a", "b", 0, -1.0),))
    with pytest.raises(ValueError, match="shard"):
        sharding.balanced(0)
