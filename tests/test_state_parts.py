"""The state of a stream is kept in parts of a bounded number of rows."""

from __future__ import annotations

import glob

from terrane.streaming import counts


def test_parts_of_the_state_grow_with_the_rows(spark, tmp_path):
    assert counts.parts_for(36_000_000, 12) == 72 and counts.parts_for(10, 12) == 12
    rows = spark.range(40).selectExpr("id % 5 AS cell", "id AS species_id", "2000 AS year")
    rows.write.parquet(str(tmp_path / "in"))
    stream = counts.occurrence_stream(spark, str(tmp_path / "in"), rows.schema)
    found = counts.streamed_counts(stream)
    counts.keep_table(found, str(tmp_path / "out"), str(tmp_path / "state"), ["cell", "species_id"], buckets=3, parts=7).awaitTermination()
    assert len(glob.glob(str(tmp_path / "state/state/0/[0-9]*"))) == 7  # it was what the session shuffles to, however many rows
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert counts.kept_table(spark, str(tmp_path / "out"), found.schema).count() == 40
