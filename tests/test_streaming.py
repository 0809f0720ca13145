"""Counts that are kept by merging batches into buckets."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from terrane.streaming import counts as S

KEYS = ["cell", "species_id"]


def records(spark, rows):
    return spark.createDataFrame(rows, "cell int, species_id int, year int")


def table(spark, where, schema):
    return sorted(tuple(r) for r in S.kept_table(spark, f"{where}/out", schema).collect())


def want(rows):
    found = {}
    for cell, species, _ in rows:
        if cell is not None:
            found[cell, species] = found.get((cell, species), 0) + 1
    return sorted((*k, n) for k, n in found.items())


def test_batches_are_merged_and_only_their_buckets_written(spark, tmp_path):
    where = f"file://{tmp_path}"
    one = [(c, s, 2000) for c in range(20) for s in range(5)] + [(None, 1, 2000)]
    records(spark, one).coalesce(1).write.parquet(f"{where}/in")
    rows = S.occurrence_stream(spark, f"{where}/in", records(spark, one).schema, per_batch=1)
    counts = S.streamed_counts(rows)
    run = lambda: S.keep_table(counts, f"{where}/out", f"{where}/state", KEYS, 8).awaitTermination()
    run()
    assert table(spark, where, counts.schema) == want(one)
    first = {p.name for p in Path(tmp_path, "out").glob("batch=*/bucket=*")}
    assert len(first) == 8
    two = [(3, 4, 2001), (3, 4, 2001), (3, 4, 2002)]
    records(spark, two).coalesce(1).write.mode("append").parquet(f"{where}/in")
    run()
    assert table(spark, where, counts.schema) == want(one + two)
    newest = max(Path(tmp_path, "out").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))
    assert len(list(newest.glob("bucket=*"))) == 1


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    where = f"file://{tmp_path}"
    totals = lambda rows: spark.createDataFrame(rows, "cell int, species_id int, n_obs long")
    schema = totals([]).schema
    put = lambda rows, n: S.merge_batch(totals(rows), n, f"{where}/out", KEYS, 4)
    put([(1, 1, 5), (2, 2, 1)], 0)
    put([(1, 1, 7), (3, 3, 2)], 1)
    after = [(1, 1, 7), (2, 2, 1), (3, 3, 2)]
    assert table(spark, where, schema) == after
    put([(1, 1, 7), (3, 3, 2)], 1)
    assert table(spark, where, schema) == after
    # A batch that broke off has no mark of success: nobody sees it, and running it again mends it.
    put([(1, 1, 9)], 2)
    mark = Path(tmp_path, "out", "batch=2", "_SUCCESS")
    mark.unlink()
    assert table(spark, where, schema) == after
    put([(1, 1, 9)], 2)
    assert table(spark, where, schema) == [(1, 1, 9), (2, 2, 1), (3, 3, 2)]
    put([], 3)
    for n in range(4, 9):
        put([(1, 1, n + 10)], n)
    assert table(spark, where, schema)[0] == (1, 1, 18)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(1), F.lit(1)), F.lit(4))).first()[0]
    assert len(list(Path(tmp_path, "out").glob(f"batch=*/bucket={bucket}"))) <= 3  # old versions go
    assert S.kept_table(spark, f"{where}/nothing", schema).count() == 0
