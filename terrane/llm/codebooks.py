"""Compression of vectors to codes: product quantisation in integers over weighted distinct parts.

Every vector is scaled to integers and cut into equal parts. Equal parts of a position become one row with its number of
occurrences, and Lloyd's rounds run over these weighted rows: each is assigned to the nearest entry of its position's
codebook, and entries become the floored means of their weighted parts. Codes and errors of the distinct parts are then
joined back to the vectors.

Tasks put their vectors in blocks, in which a part is held once and vectors name it by its place; so a part that a third of
all vectors share is one row a block in the grouping and in the join back, and neither needs salt. The driver holds the
codebooks (positions x entries x width, all parameters) and the sums that make them.

Defined results: vectors that are null or hold null or non-finite components are dropped. The first codebook comes from the
smallest ids that are not null, rows of one id in the order of their vectors; with fewer vectors than entries the codebook
is as long as there are vectors. Ties go to the lower entry; an entry that no part chose stays. Rows with equal ids are rows each. Vectors of
different lengths, or of a length that is not a multiple of the parts, raise ValueError; components beyond 2^26 after scaling
raise ArithmeticError, as sums of squares must fit 64 bits. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.tables import bounded_batches, salted_join, written

#: Vectors of a block, and the largest component after scaling.
BLOCK_ROWS, LARGEST = 4096, 1 << 26
#: Labels that are sent to all tasks with their sums; beyond it rows of one label are dealt to several tasks.
MOST_LABELS = 100_000


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: float = 256.0

    def __post_init__(self) -> None:
        if not 1 <= self.entries <= 256 or self.parts < 1 or self.rounds < 0:
            raise ValueError("there must be 1 to 256 entries, a part and no negative number of rounds")


def sound(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(rows: pa.Array | pa.ChunkedArray, settings: Settings) -> np.ndarray:
    """Vectors as rows of (part, component) integers; all floors go down."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.diff(rows.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1 or (len(sizes) and (sizes[0] % settings.parts or not sizes[0])):
        raise ValueError(f"vectors must be of one length, a multiple of {settings.parts}")
    values = np.floor(settings.scale * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(values) and np.abs(values).max() > LARGEST:
        raise ArithmeticError("a component is too large to be squared and summed in 64 bits")
    return values.astype(np.int32).reshape(len(sizes), settings.parts, -1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower one of equals, and the squared distance; in integers."""
    best, code = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    for k, entry in enumerate(entries.astype(np.int64)):
        far = ((parts - entry) ** 2).sum(1)
        closer = far < best
        best[closer], code[closer] = far[closer], k
    return code, best


def _blocks(settings: Settings):
    """Rows of two kinds: a distinct part of a block with its weight and place, and a vector with the places of its parts."""

    def rows(ids: list, labels: pa.Array, vectors: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
        values = integers(vectors, settings)
        places = np.zeros(values.shape[:2], np.int32)
        for p in range(settings.parts):
            raw = np.ascontiguousarray(values[:, p])
            keys = raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
            which, places[:, p], weight = np.unique(keys, return_inverse=True, return_counts=True)
            n = len(which)
            yield pa.record_batch([pa.array([block] * n, pa.int64()), pa.array([p] * n, pa.int32()), pa.array([w.tobytes() for w in which], pa.binary()), pa.array(weight.astype(np.int64)), pa.array(range(n), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, labels.type), pa.nulls(n, pa.binary())], NAMES)
        n = len(ids)
        yield pa.record_batch([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(ids, pa.int64()), labels, pa.array([r.tobytes() for r in places], pa.binary())], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held = batch.slice(at, BLOCK_ROWS)
                yield from rows(held.column(0).to_pylist(), held.column(1), held.column(2), block)
                block += 1

    return run


NAMES = ["block", "position", "part", "weight", "place", "vec_id", "label", "places"]


def _assigned(codebooks: np.ndarray):
    """Distinct parts with their code and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, far = assign(batch, codebooks)
            yield pa.record_batch([*batch.columns, pa.array(codes.astype(np.int32)), pa.array(far)], [*batch.schema.names, "code", "error"])

    return run


def decoded(parts: pa.Array, width: int) -> np.ndarray:
    """Parts from their bytes."""
    if len(parts) and set(pc.unique(pc.binary_length(parts)).to_pylist()) != {4 * width}:
        raise ValueError("vectors must be of one length")
    return np.frombuffer(b"".join(parts.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def assign(batch: pa.RecordBatch, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    position, parts = batch.column("position").to_numpy(), decoded(batch.column("part"), codebooks.shape[2])
    codes, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for p in np.unique(position).tolist():
        at = np.flatnonzero(position == p)
        codes[at], far[at] = nearest(parts[at], codebooks[p])
    return codes, far


def _sums(codebooks: np.ndarray):
    """For each position and entry of a task's distinct parts, their weight and weighted sums."""
    n_parts, n_entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's sums pass 64 bits only beyond 2^37 vectors of the largest components; all tasks' are summed as decimals.
        weights, totals = np.zeros(n_parts * n_entries, np.int64), np.zeros((n_parts * n_entries, width), np.int64)
        for batch in batches:
            slot = batch.column("position").to_numpy().astype(np.int64) * n_entries + assign(batch, codebooks)[0]
            weight, parts = batch.column("weight").to_numpy(), decoded(batch.column("part"), width)
            np.add.at(weights, slot, weight)
            np.add.at(totals, slot, parts * weight[:, None])
        met = np.flatnonzero(weights)
        yield pa.record_batch([pa.array(met), pa.array(weights[met]), *[pa.array(totals[met, i]) for i in range(width)]], ["slot", "weight", *[f"c{i}" for i in range(width)]])

    return run


class Quantizer:
    """Codebooks of a table of vectors, and the tables they were made from."""

    def __init__(self, rows: DataFrame, settings: Settings | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label"):
        self.settings = settings = settings or Settings()
        bounded_batches(rows.sparkSession)
        vector = F.col(f"`{vec_col}`")
        label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
        kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), vector.cast("array<double>").alias("vector")).filter(sound(F.col("vector")))
        self.label_type = kept.schema["label"].dataType.simpleString()
        schema = f"block long, position int, part binary, weight long, place int, vec_id long, label {self.label_type}, places binary"
        self.blocks, _ = written(kept.mapInArrow(_blocks(settings), schema))
        self.distinct, _ = written(self.blocks.filter("position IS NOT NULL").groupBy("position", "part").agg(F.sum("weight").alias("weight")))
        # The first entries: as many rows as the codebook has, which is a parameter.
        first = kept.filter("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(settings.entries).select("vector").toArrow().column("vector")
        start = integers(first, settings) if len(first) else np.zeros((0, settings.parts, 1), np.int32)
        self.codebooks = np.ascontiguousarray(start.transpose(1, 0, 2)).astype(np.int64)
        for _ in range(settings.rounds if len(first) else 0):
            self.codebooks = self._round()

    def _round(self) -> np.ndarray:
        parts, entries, width = self.codebooks.shape
        names = [f"c{i}" for i in range(width)]
        sums = self.distinct.mapInArrow(_sums(self.codebooks), ", ".join(["slot long", "weight long", *[f"{c} long" for c in names]]))
        out = self.codebooks.reshape(parts * entries, width).copy()
        for r in sums.groupBy("slot").agg(F.sum("weight").alias("weight"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names]).collect():
            out[r["slot"]] = [int(r[c]) // r["weight"] for c in names]
        return out.reshape(parts, entries, width)

    def digest(self) -> str:
        """sha256 of all entries' components, by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def encoded(self) -> DataFrame:
        """vec_id, label, code (two hexadecimal digits a part) and error of every kept row."""
        if not self.codebooks.shape[1]:
            return self.blocks.sparkSession.createDataFrame([], f"vec_id long, label {self.label_type}, code string, error long")
        coded = self.distinct.select("position", "part").mapInArrow(_assigned(self.codebooks), "position int, part binary, code int, error long")
        asked = self.blocks.filter("position IS NOT NULL").select("block", "position", "part", "place")
        answers = asked.join(coded, ["position", "part"]).select(F.col("block").alias("asking"), "position", "place", "code", "error")
        vectors = self.blocks.filter("position IS NULL").select("block", "vec_id", "label", "places")
        parts = self.settings.parts

        def run(rows: pa.Table, found: pa.Table) -> pa.Table:
            position, place = (found.column(c).to_numpy() for c in ("position", "place"))
            code, error = np.zeros((parts, place.max() + 1), np.uint8), np.zeros((parts, place.max() + 1), np.int64)
            code[position, place], error[position, place] = found.column("code").to_numpy(), found.column("error").to_numpy()
            at = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.int32).reshape(-1, parts)
            own = code[np.arange(parts), at]
            return pa.table([rows.column("vec_id"), rows.column("label"), pa.array([r.tobytes().hex() for r in own]), pa.array(error[np.arange(parts), at].sum(1))], ["vec_id", "label", "code", "error"])

        return vectors.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(run, f"vec_id long, label {self.label_type}, code string, error long")

    def decoded(self, codes: DataFrame) -> DataFrame:
        """vec_id, vector: what the codes stand for, scaled back."""
        table = (self.codebooks / self.settings.scale).tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [[x for part, c in zip(table, bytes.fromhex(code), strict=True) for x in part[c]] for code in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["vec_id", "vector"])

        return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def compress_embeddings(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows of the label, nulls together), codebooks_sha256."""
    made = Quantizer(rows, settings)
    coded, _ = written(made.encoded())
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label")
    sums, _ = written(coded.groupBy(key).agg(F.sum("error").alias("label_error")))
    few = sums.count() <= MOST_LABELS
    marked = coded.select("vec_id", "code", "error", key)
    both = marked.join(F.broadcast(sums), "_label") if few else salted_join(marked, sums, "_label", "vec_id")
    return both.select("vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))
