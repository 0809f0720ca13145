"""The fact table kept up to date from a folder of occurrence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from terrane.functions.columns import integer, period


def occurrence_stream(spark: SparkSession, folder: str, schema: T.StructType, per_batch: int = 16) -> DataFrame:
    """Rows of parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def streamed_counts(rows: DataFrame, bounds: list[int] | None = None, cell: str = "cell", species: str = "species_id", year: str = "year") -> DataFrame:
    """Counts by cell and species (and period): the same as the batch count, as sums of parts are."""
    keys = [cell, species]
    if bounds:
        rows, keys = rows.withColumn("period", period(integer(year), bounds)), [*keys, "period"]
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n_obs"))


def streamed_windows(rows: DataFrame, time: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by time window and keys, with a watermark that bounds the state."""
    return rows.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """For each bucket the numbers of the finished batches that wrote it, in order; those before ``below`` if given."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for one in files.globStatus(hadoop.Path(f"{path}/batch=*/bucket=*")) or []:
        where = one.getPath()
        number, bucket = int(where.getParent().getName().split("=")[1]), int(where.getName().split("=")[1])
        if (below is None or number < below) and files.exists(hadoop.Path(where.getParent(), "_SUCCESS")):
            found.setdefault(bucket, []).append(number)
    return {b: sorted(n) for b, n in found.items()}


def _read(spark: SparkSession, path: str, schema: T.StructType, chosen: dict[int, int]) -> DataFrame:
    paths = [f"{path}/batch={n}/bucket={b}" for b, n in sorted(chosen.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def kept_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as the last finished batches left it: of each bucket its newest version."""
    return _read(spark, path, schema, {b: n[-1] for b, n in _versions(spark, path).items()})


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], buckets: int = 64) -> None:
    """Puts a batch of new totals into the table: only buckets that hold a key of it are written, as versions with the
    batch's number.

    A batch is visible when its folder is complete, and reads versions of smaller numbers only; so one that is run again,
    after a failure or not, leaves the same table. The version before the newest is kept for readers, older ones go.
    """
    spark = batch.sparkSession
    schema = batch.schema
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    held = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r[0] for r in held.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        before = _versions(spark, path, number)
        old = _read(spark, path, schema, {b: before[b][-1] for b in touched if b in before})
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        rest = old.join(held.select(*keys), keys, "left_anti").select(*schema.names, bucket)
        rest.unionByName(held).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        for b in touched:
            for n in before.get(b, [])[:-1]:
                files.delete(hadoop.Path(f"{path}/batch={n}/bucket={b}"), True)
    finally:
        held.unpersist()


#: Rows of a part of the state, or of a bucket: nearly every row may be a key of its own, which takes some 300 bytes.
PART = 500_000


def parts_for(rows: int, least: int) -> int:
    """How many parts of the state, or buckets, so many rows call for."""
    return max(least, -(-rows // PART))


def keep_table(counts: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = 64, parts: int | None = None) -> StreamingQuery:
    """Keeps the table of counts (see ``kept_table``) by the keys that each batch changes, until the files that are there
    are used up. Keys must not be null. A stream keeps the number of its state's parts for good: ``parts``, or else as many as
    the session shuffles to."""

    def put(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, keys, buckets)

    conf, name = counts.sparkSession.conf, "spark.sql.shuffle.partitions"
    own = conf.get(name)
    conf.set(name, parts or own)
    try:
        return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, own)
