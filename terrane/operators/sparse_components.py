"""Principal components of cells over very many species, without a dense row.

A cell is the list of its species' slots and values. The covariance of the centred table is never formed: a block of trial
vectors (species x a few columns) goes to the tasks, each multiplies its cells by it and the result by its cells again, and
the products are summed by species. Centring is implied: the means' part is taken off each cell's product.

The subspace starts at random and grows by the residuals of its best vectors; when it is wide it is cut to its best part. It ends when
the residuals are small against the largest variance, so the error is measured and not assumed from a number of rounds.
The driver holds species x columns numbers, all of them sums over cells, and checks their size first; where cells are fewer
than species it holds cells x columns, and the tasks have lists by species.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.stored import stored

#: Numbers of the subspace and its image that the driver may hold (1 GB), and products laid out at a time in a task.
MOST_HELD, LAID_OUT = 1 << 27, 1 << 22
#: Rows of species that one row of sums holds.
SLOTS = 4096
#: Blocks of the subspace before it is cut, and those that stay: the values of a large table lie so close that a narrow
#: subspace, cut often, needs several times as many rounds. Where its numbers (with its image's) would be more than WIDE, fewer.
BLOCKS, KEPT, WIDE = 20, 8, 1 << 25


@dataclass
class SparseTable:
    """Lists of one side (``<key>``, slots, values), the other side by slot (kind, slot), and how many there are of both.

    As made by ``sparse_table`` the lists are those of cells and the slots are species; ``turned`` is the other way round.
    """

    rows: DataFrame
    species: DataFrame
    cells: int
    width: int


def _slots(values: DataFrame, key: str) -> DataFrame:
    """(kind, slot): the distinct keys, numbered in ascending order without a window over all of them."""
    sorted_ = stored(values.select(F.col(key).alias("kind")).distinct().orderBy("kind").withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return stored(sorted_.withColumn("part", part).join(F.broadcast(starts), "part").select("kind", (F.col("start") + F.col("mark").bitwiseAND((1 << 33) - 1)).cast("int").alias("slot")))


def _means(rows: DataFrame, value: str, cell: str, species: str) -> DataFrame:
    return stored(rows.dropna(subset=[cell, species]).groupBy(F.col(cell).alias("cell"), F.col(species).alias("kind")).agg(F.avg(value).cast("double").alias("v")))


def _lists(values: DataFrame, key: str, other: str, numbered: DataFrame) -> DataFrame:
    """Of each key the slots and values of the other side; as long as these are many, nulls, for zeros, are not collected."""
    entries = values.join(numbered.withColumnRenamed("kind", other), other).withColumn("e", F.when(F.col("v") != 0, F.struct("slot", "v")))
    packed = entries.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return stored(packed.select(key, F.col("e.slot").alias("slots"), F.col("e.v").alias("values")))


def _table(values: DataFrame, turned: bool) -> SparseTable:
    key, other = ("kind", "cell") if turned else ("cell", "kind")
    numbered = _slots(values, other)
    held = _lists(values, key, other, numbered)
    return SparseTable(held, numbered, held.count(), numbered.count())


def sparse_table(rows: DataFrame, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> SparseTable:
    """Mean values by cell and species."""
    return _table(_means(rows, value, cell, species), False)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, slots and values of a batch's entries, one after the other."""
    slots, values = batch.column("slots"), batch.column("values")
    sizes = np.diff(slots.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy(), values.flatten().to_numpy()


def _products(row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The rows, less the means, times the basis."""
    out = np.empty((n, basis.shape[1]))
    for c in range(basis.shape[1]):
        out[:, c] = np.bincount(row, value * basis[slot, c], n) - offset[c]
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with LAID_OUT entries or so at a time, one row at least."""
    ends, at = np.cumsum(np.diff(batch.column("slots").offsets.to_numpy())), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + LAID_OUT, "right")))
        yield batch.slice(at, end - at)
        at = end


def image(table: SparseTable, basis: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The centred table's transpose times the centred table times the basis, summed in Spark by slots."""
    spark = table.rows.sparkSession
    sent = spark.sparkContext.broadcast((basis, means @ basis))
    width, columns = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, offset = sent.value
        total, seen = np.zeros((width, columns)), False
        for batch in batches:
            for part in _chunks(batch):
                row, slot, value = _arrays(part)
                seen = seen or bool(len(row))
                products = _products(row, slot, value, part.num_rows, basis, offset)
                for c in range(columns):
                    total[:, c] += np.bincount(slot, value * products[row, c], width)
        for at in range(0, width if seen else 0, SLOTS):
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total[at : at + SLOTS].tobytes()])], ["at", "sums"])

    def add(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b.as_py(), np.float64) for b in group.column("sums"))
        return pa.table({"at": group.column("at").slice(0, 1), "sums": pa.array([sums.tobytes()])})

    found = table.rows.select("slots", "values").mapInArrow(run, "at int, sums binary").groupBy("at").applyInArrow(add, "at int, sums binary").toArrow()
    out = np.zeros((width, columns))
    for at, data in zip(found.column("at").to_pylist(), found.column("sums").to_pylist(), strict=True):
        out[at : at + SLOTS] = np.frombuffer(data, np.float64).reshape(-1, columns)
    sent.destroy()
    return out


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The block's directions that are not in ``against`` (orthonormal columns), as orthonormal columns."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8]
    return u - against @ (against.T @ u)


def sparse_components(rows: DataFrame, components: int | None = None, variance: float = 0.9, most: int = 50, tolerance: float = 1e-7, rounds: int = 300, seed: int = 0, value: str = "n_obs", cell: str = "cell", species: str = "species_id") -> tuple[DataFrame, list[float], DataFrame]:
    """(cell, PC1 .. PCk) of the centred, unscaled table, the components' shares of the variance, and (species, PC1 .. PCk)
    of their loadings.

    k is given, or the first number whose shares reach ``variance``, at most ``most``. The largest loading of a component is
    positive. Cells whose values are all 0 count. ArithmeticError if the residuals do not fall below ``tolerance`` times the
    largest variance in ``rounds``; ValueError for a table without a cell or with too many species to hold.
    """
    values = _means(rows, value, cell, species)
    cells, kinds = (int(v) for v in values.agg(F.count_distinct("cell"), F.count_distinct("kind")).first())
    if not cells:
        raise ValueError("there is no cell")
    wanted = min(components or most, kinds)
    # The driver holds the shorter side: vectors over cells and over species have the same variances.
    turned = kinds > cells > 2 * (wanted + 10)
    table = _table(values, turned)
    block = min(table.width, wanted + 10)
    if 8 * block * table.width > MOST_HELD:
        raise ValueError("too many species for the subspace to be held")
    if turned:
        return _from_cells(table, cells, kinds, wanted, components, variance, tolerance, rounds, seed, cell, species)
    figures = table.rows.select(F.posexplode(F.arrays_zip("slots", "values"))).select("col.slots", "col.values").groupBy("slots").agg(F.sum("values").alias("s"), F.sum(F.col("values") * F.col("values")).alias("q")).toArrow()
    sums, squares = np.zeros(table.width), 0.0
    if len(figures):
        sums[figures.column("slots").to_numpy()] = figures.column("s").to_numpy()
        squares = float(figures.column("q").to_numpy().sum())
    means = sums / table.cells
    total = squares - table.cells * float(means @ means)
    if table.width <= 2 * block:
        start = np.eye(table.width)
    else:
        start = _orthonormal(np.random.default_rng(seed).normal(size=(table.width, block)), np.zeros((table.width, 0)))
    found, best = _settled(lambda b: image(table, b, means), start, np.zeros((table.width, 0)), wanted, block, tolerance, 1e-14 * squares, rounds)
    shares, k = _shares(found, wanted, total, components, variance)
    loadings = best[:, :k] * np.where(best[np.abs(best[:, :k]).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    names = [f"PC{i + 1}" for i in range(k)]
    return _of_lists(table, "cell", loadings, means @ loadings, cell, names), shares[:k], _of_slots(table, loadings, species, names)


def _from_cells(table: SparseTable, cells: int, kinds: int, wanted: int, components: int | None, variance: float, tolerance: float, rounds: int, seed: int, cell: str, species: str) -> tuple[DataFrame, list[float], DataFrame]:
    """``sparse_components`` by vectors over the cells, from lists by species: what is held is as long as cells are many.

    Vectors stay centred, so the means fall away; a component's scores are its vector times the root of its variance, its
    loadings the lists' products with the vector over that root.
    """
    v = F.col("values")
    per = table.rows.select(F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    squares, centre = (float(x or 0.0) for x in per.agg(F.sum("q"), F.sum(F.col("s") * F.col("s"))).first())
    none = np.zeros(cells)

    def centred(block: np.ndarray) -> np.ndarray:
        return block - block.mean(0)

    block = wanted + 10
    constant = np.full((cells, 1), cells**-0.5)
    start = _orthonormal(np.random.default_rng(seed).normal(size=(cells, block)), constant)
    low = 1e-14 * squares
    found, best = _settled(lambda b: centred(image(table, b, none)), start, constant, wanted, block, tolerance, low, rounds)
    shares, k = _shares(found, wanted, squares - centre / cells, components, variance)
    names = [f"PC{i + 1}" for i in range(k)]
    roots = np.sqrt(np.maximum(found[:k], 0))
    turned = np.where(found[:k] > low, 1 / np.where(found[:k] > low, roots, 1), 0)
    free = _of_lists(table, "kind", best[:, :k] * turned, np.zeros(k), species, names)
    largest = free.agg(*[F.min(F.struct((-F.abs(n)).alias("far"), F.col(f"`{species}`"), F.col(n).alias("v"))).alias(n) for n in names]).first()
    signs = np.array([-1.0 if largest[n]["v"] < 0 else 1.0 for n in names])
    scores = _of_slots(table, best[:, :k] * roots * signs, cell, names)
    return scores, shares[:k], free.select(F.col(f"`{species}`"), *[(F.col(n) * sign).alias(n) for n, sign in zip(names, signs.tolist(), strict=True)])


def _settled(times: Callable[[np.ndarray], np.ndarray], basis: np.ndarray, beside: np.ndarray, wanted: int, block: int, tolerance: float, low: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest values and their vectors, whose residuals are below ``tolerance`` times the largest value, or ``low``; the
    subspace stays apart from the columns of ``beside``."""
    width = len(basis) - beside.shape[1]
    most = max(4, min(BLOCKS, WIDE // (2 * block * len(basis))))
    kept = KEPT if most == BLOCKS else most // 2
    held = times(basis)
    for _ in range(rounds):
        inner = basis.T @ held
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-found)
        found, turn = found[order], turn[:, order]
        best, best_image = basis @ turn[:, :block], held @ turn[:, :block]
        residual = best_image - best * found[:block]
        open_ = np.linalg.norm(residual[:, :wanted], axis=0) > max(tolerance * found[0], low, 1e-300)
        if not open_.any() or basis.shape[1] >= width:
            return found, best
        if basis.shape[1] + block > most * block:
            basis, held = basis @ turn[:, : kept * block], held @ turn[:, : kept * block]
        fresh = _orthonormal(residual[:, np.append(open_, np.ones(block - wanted, bool))], np.hstack([beside, basis]))
        if not fresh.shape[1]:
            return found, best
        basis, held = np.hstack([basis, fresh]), np.hstack([held, times(fresh)])
    raise ArithmeticError(f"the components have not settled in {rounds} rounds")


def _shares(found: np.ndarray, wanted: int, total: float, components: int | None, variance: float) -> tuple[list[float], int]:
    """The components' shares of the variance, and how many are asked for."""
    shares = (np.maximum(found[:wanted], 0) / total if total > 0 else np.zeros(wanted)).tolist()
    if components is not None:
        return shares, wanted
    reached = np.flatnonzero(np.cumsum(shares) >= variance - 1e-12)
    return shares, int(reached[0]) + 1 if len(reached) else wanted


def _of_lists(table: SparseTable, key: str, matrix: np.ndarray, offset: np.ndarray, name: str, names: list[str]) -> DataFrame:
    """Each list times the matrix, less the offset."""
    sent = table.rows.sparkSession.sparkContext.broadcast((matrix, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, offset = sent.value
        for batch in batches:
            for part in _chunks(batch):
                scores = _products(*_arrays(part), part.num_rows, matrix, offset)
                yield pa.record_batch([part.column(key), *[pa.array(scores[:, i]) for i in range(len(names))]], [name, *names])

    kind = table.rows.schema[key].dataType.simpleString()
    return table.rows.mapInArrow(run, ", ".join([f"`{name}` {kind}", *[f"{n} double" for n in names]]))


def _of_slots(table: SparseTable, matrix: np.ndarray, name: str, names: list[str]) -> DataFrame:
    """The matrix's rows by the keys of their slots."""
    sent = table.rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sent.value[batch.column("slot").to_numpy()]
            yield pa.record_batch([batch.column("kind"), *[pa.array(own[:, i]) for i in range(len(names))]], [name, *names])

    kind = table.species.schema["kind"].dataType.simpleString()
    return table.species.mapInArrow(run, ", ".join([f"`{name}` {kind}", *[f"{n} double" for n in names]]))
