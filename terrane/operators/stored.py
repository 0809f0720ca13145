"""Tables written on the way, where a plan would be computed several times or grows from round to round."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of this driver: results may still read them, so they go when it ends.
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset, a folder of this machine in a local
    session, and ValueError on a cluster, whose executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("terrane.stored.folder", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='terrane-')}"
        spark.conf.set("terrane.stored.folder", found)
    return found


def stored(frame: DataFrame) -> DataFrame:
    """The rows as a table, read back: lineage is cut, and lost executors cost no step before it."""
    path = f"{folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    _made.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows numbered from 0 in an order that must tell all rows apart: sorted by ranges, and each range starts where those
    before it end; no window over all rows."""
    rows = stored(frame.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_mark", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_mark").bitwiseAND((1 << 33) - 1)
    return stored(rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop("_mark", "_part", "_start"))


@atexit.register
def _leave() -> None:
    jvm = SparkContext._jvm
    for path in _made if jvm else []:
        with contextlib.suppress(Exception):  # the session may be gone
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
