"""Tables written on the way: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that are there: what results may still read is deleted when the driver ends.
_there: dict[str, None] = {}
#: Tables written since the innermost ``scratch`` of this thread began; another thread's are its own.
_within: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("within", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); only where it is unset in a local session, as in tests,
    one of this machine. Executors of a cluster would write to their own disks there, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("terrane.local.folder", None)
        if not found:
            found = f"file://{tempfile.mkdtemp(prefix='terrane-')}"
            spark.conf.set("terrane.local.folder", found)
    return found


def written(frame: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path for ``dropped``."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/terrane-{uuid.uuid4().hex}"
    _there[path] = None
    if (within := _within.get()) is not None:
        within.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _there.pop(path, None)


@contextlib.contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[list[str]]:
    """Deletes the tables that this thread writes within when the block ends, but for those whose paths are put in the list it
    gives; a block around it takes those for its own. After an error the tables stay until the driver ends."""
    around, kept, own = _within.get(), list(keep), []
    token = _within.set(own)
    try:
        yield kept
    finally:
        _within.reset(token)
        if around is not None:
            around += [p for p in own if p in kept]
    dropped(spark, *[p for p in own if p in _there and p not in kept])
    settled(spark)


def settled(spark: SparkSession) -> None:
    """Lets go of the shuffles of finished steps: Spark deletes their files once the driver has collected its garbage,
    which by itself it may not do for half an hour."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


@atexit.register
def _leave() -> None:
    jvm = SparkContext._jvm
    for path in list(_there) if jvm else []:
        with contextlib.suppress(Exception):  # the session may be gone
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def semi_join(rows: DataFrame, ids: DataFrame, column: str, count: int, most: int = 1_000_000) -> DataFrame:
    """Rows whose id is among ``ids``, which has ``count`` rows: sent to all tasks if there are at most ``most`` of them
    (8 MB of integers), by a shuffle of both sides otherwise."""
    return rows.join(F.broadcast(ids) if count <= most else ids, column, "left_semi")


#: Parts that rows of one key are dealt to where a key may hold a large share of all rows.
SALTS = 16


def salted_join(rows: DataFrame, side: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """Rows joined with a side of few rows a key; rows of one key are dealt to SALTS tasks by the hash of ``spread``, and
    the side's rows are repeated for each."""
    salt = F.pmod(F.xxhash64(F.lit("salt"), spread), F.lit(SALTS)).cast("int")
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [key, "_salt"], how).drop("_salt")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Batches of at most so many bytes (one row at least) between Spark and Python: with whole texts they are what memory
    is spent on. A session that asks for less keeps its setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
        spark.conf.set(name, size)


#: Rows of one key in one task from which all but one go their own way.
LOCAL = 64
#: Parts that the rows of a key that is crowded in some task are dealt to.
_APART = 64


def apart(key: str, spread: str, weight: str = "weight") -> list[Column]:
    """Columns to deal rows by where tasks have put crowded keys together (see ``text.crowded``): the key, and a part that
    is 0 for rows with a weight; rows of weight 0 need not meet any other and are spread."""
    part = F.when(F.col(weight) == 0, 1 + F.pmod(F.xxhash64(spread), F.lit(_APART))).otherwise(F.lit(0)).cast("int")
    return [F.col(key), part]


def unused(columns: list[str], name: str) -> str:
    """The name, with marks put to it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
