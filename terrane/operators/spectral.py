"""Spectral clusters of cells: a graph of nearest neighbours, found by descent and measured, and vectors of its Laplacian.

The graph starts from runs of points that lie together in random directions. In each round the neighbours of a point, and the
nearest of those it is a neighbour of, are compared with one another, for a neighbour's neighbours are likely neighbours. It
ends when next to nothing changes; then a sample of points is held against all others, and the share of true neighbours that
the graph has is returned with it. Below the asked share, more directions are added.

The vectors come from a subspace that is filtered by Chebyshev polynomials of the normalised graph: a product is a join of
links and values and a sum, and the driver sees tables of the subspace's own size only. Every cell has a place in them, so
every cell is clustered by its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.stored import stored

#: Points of a run that are compared with each other, directions at the start, rounds of descent and times they are begun.
RUN, DIRECTIONS, ROUNDS, TRIES = 128, 3, 12, 5
#: Points of the sample that recall is measured on, and parts that the rows of a much-linked point are first cut down in.
SAMPLE, PARTS = 200, 16
#: Steps of a filter, filters at most, and the residual at which the vectors are good.
STEPS, FILTERS, RESIDUAL = 8, 30, 1e-3
#: The bound below which a filter damps, at most: nearer to 1 it would damp next to nothing, however good the subspace is.
DAMPED = 0.95


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of one to all of the other, by differences where sums of squares would cancel."""
    if a.shape[0] * b.shape[0] * a.shape[1] <= 1 << 22:
        return ((a[:, None] - b[None]) ** 2).sum(2)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _runs(kind: str, neighbours: int):
    """Of points in order along a direction, the nearest within each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while len(held) >= 2 * RUN:
                yield near(held.slice(0, RUN))
                held = held.slice(RUN)
        if held is not None and len(held) > 1:
            yield near(held)

    def near(points: pa.Table) -> pa.RecordBatch:
        points = points.combine_chunks()
        ids, f = points.column("id").combine_chunks(), _matrix(points.column("f").combine_chunks())
        far = _squares(f, f)
        np.fill_diagonal(far, np.inf)
        k = min(neighbours, len(ids) - 1)
        best = np.argsort(far, 1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(ids)), k)
        return pa.record_batch([ids.take(pa.array(row)), ids.take(pa.array(best.ravel())), pa.array(far[row, best.ravel()])], ["src", "dst", "d"])

    return run, f"src {kind}, dst {kind}, d double"


def _nearest(links: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point, equal ones by id; rows of one point are first cut down in parts."""
    part = F.pmod(F.xxhash64("dst"), F.lit(PARTS))
    for by in (["src", "part"], ["src"]):
        order = Window.partitionBy(*by).orderBy("d", "dst")
        links = (links.withColumn("part", part) if "part" in by else links).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r", "part")
    return links


def _compared(kind: str):
    """Members of each centre, in order of centres: pairs that are nearer than the first's farthest neighbour so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if last is None else pa.concat_tables([last, rows]).combine_chunks()
            centres = rows.column("centre").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.append(0, np.flatnonzero(centres[1:] != centres[:-1]) + 1) if len(centres) else np.zeros(1, np.int64)
            last = rows.slice(int(cuts[-1]))
            yield from pairs(rows, cuts)
        if last is not None:
            yield from pairs(last, np.array([0, len(last)]))

    def pairs(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if len(cuts) < 2 or not len(rows):
            return
        f, bound = _matrix(rows.column("f").combine_chunks()), rows.column("bound").to_numpy()
        one, two, far = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            d = _squares(f[a:b], f[a:b])
            np.fill_diagonal(d, np.inf)
            i, j = np.nonzero(d < bound[a:b, None])
            one.append(i + a)
            two.append(j + a)
            far.append(d[i, j])
        ids = rows.column("member").combine_chunks()
        yield pa.record_batch([ids.take(pa.array(np.concatenate(one))), ids.take(pa.array(np.concatenate(two))), pa.array(np.concatenate(far))], ["src", "dst", "d"])

    return run, f"src {kind}, dst {kind}, d double"


def _recall(points: DataFrame, links: DataFrame, n: int, k: int, kind: str) -> float:
    """The share of a sample's k nearest, among all points, that the graph has; equal distances count alike."""
    asked = points.filter(F.pmod(F.xxhash64(F.lit("asked"), "id"), F.lit(max(1, n // SAMPLE))) == 0).orderBy(F.xxhash64("id")).limit(2 * SAMPLE).toArrow()
    ids, f = asked.column("id").to_pylist(), _matrix(asked.column("f").combine_chunks())
    if not ids or n < 2:
        return 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, d = batch.column("id").to_pylist(), _squares(f, _matrix(batch.column("f")))
            place = {x: i for i, x in enumerate(own)}
            for row, x in enumerate(ids):
                if x in place:
                    d[row, place[x]] = np.inf
            few = min(k, len(own))
            best = np.sort(d, 1)[:, :few]
            yield pa.record_batch([pa.array([x for x in ids for _ in range(few)], asked.schema.field("id").type), pa.array(best.ravel())], ["src", "d"])

    exact = points.mapInArrow(run, f"src {kind}, d double").filter(F.col("d") < float("inf"))
    bound = exact.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("d"))).filter(F.col("r") == F.least(F.lit(k), F.lit(n - 1))).select("src", F.col("d").alias("bound"))
    hit = links.join(F.broadcast(bound), "src").filter(F.col("d") <= F.col("bound") * (1 + 1e-9) + 1e-12).count()
    return hit / (len(ids) * min(k, n - 1))


def neighbour_graph(points: DataFrame, k: int = 10, least: float = 0.9, seed: int = 0) -> tuple[DataFrame, float]:
    """(src, dst, d squared) of the k nearest of each of ``points`` (id, f: array of doubles), and the measured recall.

    ArithmeticError if the recall stays below ``least`` after TRIES times as many directions.
    """
    points = stored(points)
    kind, n = points.schema["id"].dataType.simpleString(), points.count()
    width = (points.select(F.size("f")).first() or [0])[0]
    rng = np.random.default_rng(seed)
    links: DataFrame | None = None
    recall = 0.0
    for _ in range(TRIES):
        for _ in range(DIRECTIONS):
            way = F.array(*map(F.lit, rng.normal(size=width).tolist()))
            along = points.withColumn("p", F.aggregate(F.zip_with("f", way, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
            run, schema = _runs(kind, k)
            found = along.repartitionByRange("p").sortWithinPartitions("p", "id").select("id", "f").mapInArrow(run, schema)
            links = found if links is None else links.unionByName(found)
        links = stored(_nearest(links.dropDuplicates(["src", "dst"]), k))
        for _ in range(ROUNDS):
            bound = links.groupBy("src").agg(F.max("d").alias("far"), F.count("*").alias("have")).select(F.col("src").alias("id"), F.when(F.col("have") >= min(k, n - 1), F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"))
            known = points.join(bound, "id", "left").select(F.col("id").alias("member"), "f", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
            back = _nearest(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"), k)
            members = links.unionByName(back).select(F.col("src").alias("centre"), F.col("dst").alias("member")).unionAll(points.select("id", "id")).distinct()
            run, schema = _compared(kind)
            better = members.join(known, "member").select("centre", "member", "f", "bound").repartition("centre").sortWithinPartitions("centre").mapInArrow(run, schema)
            fresh = stored(_nearest(links.unionByName(better).dropDuplicates(["src", "dst"]), k))
            changed = fresh.join(links, ["src", "dst"], "left_anti").count()
            links = fresh
            if changed <= 0.001 * n * k:
                break
        recall = _recall(points, links, n, k, kind)
        if recall >= least:
            return links, recall
    raise ArithmeticError(f"the graph holds {recall:.2f} of the nearest neighbours")


def _times(links: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """The graph times the values: a join on the far end and a sum."""
    met = links.join(values.withColumnRenamed("id", "dst"), "dst")
    return met.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def _mixed(values: DataFrame, columns: list[str], turn: np.ndarray) -> DataFrame:
    """Rows times a small matrix."""
    schema = ", ".join([f"id {values.schema['id'].dataType.simpleString()}", *[f"{c} double" for c in columns[: turn.shape[1]]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.stack([batch.column(c).to_numpy() for c in columns], 1) @ turn
            yield pa.record_batch([batch.column("id"), *[pa.array(out[:, i]) for i in range(turn.shape[1])]], ["id", *columns[: turn.shape[1]]])

    return values.select("id", *columns).mapInArrow(run, schema)


def _inner(both: DataFrame, columns: list[str]) -> np.ndarray:
    """The inner products of all columns, summed in Spark."""
    m = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in columns], 1)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(m * m)), pa.array(total.ravel())], ["at", "v"])

    sums = both.select(*columns).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(m * m)
    out[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    return out.reshape(m, m)


def laplacian_vectors(links: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(id, v0 .. v(k-1)): the vectors of the k smallest values of the normalised Laplacian of a graph (src, dst, w; both
    directions given), divided by the roots of the degrees, and the values.

    ArithmeticError if the residuals stay above RESIDUAL."""
    degrees = stored(links.groupBy("src").agg(F.sum("w").alias("degree")))
    n = degrees.count()
    k = min(k, n)
    m = min(n, k + 6)
    of = lambda c: degrees.select(F.col("src").alias(c), F.col("degree").alias(f"d_{c}"))
    graph = stored(links.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("w")))
    columns, images = [f"v{i}" for i in range(m)], [f"z{i}" for i in range(m)]
    values = stored(degrees.select(F.col("src").alias("id"), *[(F.xxhash64(F.lit(seed), F.lit(i), "src") / float(2**63)).alias(c) for i, c in enumerate(columns)]))
    for _ in range(FILTERS):
        product = _times(graph, values, columns).select("id", *[F.col(c).alias(z) for c, z in zip(columns, images, strict=True)])
        both = stored(values.join(product, "id"))
        inner = _inner(both, [*columns, *images])
        own, mixed, image = inner[:m, :m], inner[:m, m:], inner[m:, m:]
        # Directions that have fallen together are left out.
        size, axes = np.linalg.eigh((own + own.T) / 2)
        kept = size > 1e-12 * size.max()
        root = axes[:, kept] / np.sqrt(size[kept])
        found, turn = np.linalg.eigh(root.T @ ((mixed + mixed.T) / 2) @ root)
        turn, found = (root @ turn)[:, ::-1], found[::-1]
        error = np.sqrt(np.maximum(np.diag(turn.T @ image @ turn) - found**2, 0))
        if len(found) >= k and error[:k].max() <= RESIDUAL:
            chosen = _mixed(values, columns, turn[:, :k])
            scaled = chosen.join(degrees.withColumnRenamed("src", "id"), "id").select("id", *[(F.col(c) / F.sqrt("degree")).alias(c) for c in columns[:k]])
            return scaled, (1 - found[:k]).tolist()
        # Chebyshev steps: what lies below the subspace's least value stays small, the rest grows.
        low, high = -1.0, min(float(found[-1]), DAMPED)
        middle, half = (low + high) / 2, max((high - low) / 2, 1e-3)
        columns, images = columns[: len(found)], images[: len(found)]
        m = len(found)
        before = stored(_mixed(both.select("id", *[f"v{i}" for i in range(turn.shape[0])]), [f"v{i}" for i in range(turn.shape[0])], turn))
        now, first = before, True
        for _ in range(STEPS):
            step = _times(graph, now, columns).select("id", *[F.col(c).alias(f"s_{c}") for c in columns])
            joined = now.join(step, "id").join(before.select("id", *[F.col(c).alias(f"b_{c}") for c in columns]), "id")
            shifted = lambda c: (F.col(f"s_{c}") - middle * F.col(c)) / half  # noqa: E731, B023
            fresh = joined.select("id", *[(shifted(c) if first else 2 * shifted(c) - F.col(f"b_{c}")).alias(c) for c in columns])
            before, now, first = now, stored(fresh), False
        values = now
    raise ArithmeticError("the vectors of the graph have not settled")


def spectral_clusters(vectors: DataFrame, k: int, cell: str = "cell", neighbours: int = 10, seeds: int = 5, least: float = 0.9) -> tuple[DataFrame, float]:
    """(cell, cluster from 0) of every row of ``vectors`` (cell, features), and the recall of the graph. Links weigh
    1 / (1 + distance / mean distance) and hold both ways."""
    points = vectors.select(F.col(cell).alias("id"), vector_to_array("features").alias("f"))
    links, recall = neighbour_graph(points, neighbours, least)
    mean = links.agg(F.avg(F.sqrt("d"))).first()[0] or 1.0
    weighed = links.select("src", "dst", (1 / (1 + F.sqrt("d") / mean)).alias("w"))
    graph = weighed.unionAll(weighed.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    placed, _ = laplacian_vectors(graph, k)
    names = [c for c in placed.columns if c != "id"]
    table = stored(placed.select("id", array_to_vector(F.array(*names)).alias("features")))
    models = [KMeans(k=k, seed=s).fit(table) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(table).select(F.col("id").alias(cell), F.col("prediction").alias("cluster")), recall
