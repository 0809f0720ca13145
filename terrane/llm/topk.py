"""Exact top-k by inner product over an impact-ordered index, score at a time.

Rows are dealt to shards and queries to blocks of bounded sizes; each (block, shard) pair is one group. In a shard every
dimension has a posting of its rows with a value other than 0, ordered by descending quantised impact (the size of the
value in bits) and cut into one segment for each impact. Segments of all dimensions are taken in descending order of
impact, for all queries of the block together, and added to the scores of their rows. What is still to come for a row is
at most the product of the norms of the query and of the row's untaken values, so after each impact a row whose highest
possible score is below the k-th lowest possible one is out. The search stops when this has left few rows, and rescores
those exactly; where this proves nothing, the last segments make all scores exact.

Values are integers: scores are summed in single or double precision where sums of products stay exact there, in 64-bit
integers beyond, and in Python's own beyond those.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors of
unequal lengths count as filled with zeros; rows of one id count once (the smallest vector); ties go to the smaller id;
an empty table gives no rows. ArithmeticError if a score does not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: The search stops when at most so many rows a query, on average, can still be among the k.
FEW = 200


def _kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The numbers in which all sums of products are exact."""
    size = lambda x: max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    top = size(queries) * size(vectors) * max(queries.shape[1], 1)
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object


class ImpactIndex:
    """Vectors of integers, as postings by dimension in segments of descending impact.

    ``segments[i]`` has for one impact its postings of all dimensions: the rows laid end to end, their values, and where
    each dimension begins.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        sizes = np.abs(vectors)
        # The impact is the number of bits of a value's size, so a segment's values differ by a factor of two at most.
        impact = np.frexp(sizes.astype(np.float64))[1].astype(np.int16)
        rows, dims = np.nonzero(sizes)
        impacts = impact[rows, dims]
        order = np.lexsort((rows, dims, -impacts))
        rows, dims, impacts = rows[order].astype(np.int32), dims[order], impacts[order]
        values = vectors[rows, dims]
        left = (vectors.astype(np.float64) ** 2).sum(1)
        self.segments, self.rest = [], []
        cuts = np.flatnonzero(np.concatenate([[True], impacts[1:] != impacts[:-1], [True]])) if len(rows) else np.zeros(1, np.int64)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = slice(low, high)
            self.segments.append((rows[part], values[part], np.searchsorted(dims[part], np.arange(width + 1))))
            left = left - np.bincount(rows[part], values[part].astype(np.float64) ** 2, n)
            self.rest.append(np.sqrt(np.maximum(left, 0)) + 1e-9 * np.sqrt(np.maximum(left, 0)) + 1e-3)

    def add(self, scores: np.ndarray, queries: np.ndarray, segment: int) -> None:
        """Adds what one impact's postings give to the scores (row, query)."""
        rows, values, cuts = self.segments[segment]
        if len(rows) * 4 > scores.shape[0] * queries.shape[1]:
            # Postings that hold most rows are multiplied as a block, which is the same sum.
            dense = np.zeros((scores.shape[0], queries.shape[1]), scores.dtype)
            dense[rows, np.repeat(np.arange(queries.shape[1]), np.diff(cuts))] = values
            scores += dense @ queries.T
            return
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[d], cuts[d + 1])
            scores[rows[part]] += values[part, None].astype(scores.dtype) * queries[:, d]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the k best of this shard for each query, best first."""
        n = len(self.ids)
        kind = _kind(queries, self.vectors)
        q = queries.astype(kind)
        scores = np.zeros((n, len(q)), kind)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
        own = {i: r for r, i in enumerate(self.ids.tolist())}
        mine = np.array([own.get(i, -1) for i in query_ids.tolist()], np.int64)
        possible: np.ndarray | None = None
        for level in range(len(self.segments)):
            self.add(scores, q, level)
            # The proof is tried where half of the shard's values or more are in, while something is left out.
            if level + 1 == len(self.segments) or n <= max(FEW, k) or kind is object or 2 * self.rest[level].max() > self.rest_at_first():
                continue
            slack = np.outer(self.rest[level], lengths)
            lowest = scores - slack
            lowest[mine[mine >= 0], np.flatnonzero(mine >= 0)] = -np.inf
            kth = np.partition(lowest, n - k, 0)[n - k]
            open_ = scores + slack >= kth
            if open_.sum() <= FEW * len(q):
                possible = open_
                break
        for r, query_id in enumerate(query_ids.tolist()):
            rows = np.arange(n) if possible is None else np.flatnonzero(possible[:, r])
            rows = rows[rows != mine[r]]
            exact = scores[rows, r] if possible is None else self.vectors[rows].astype(kind) @ q[r]
            if possible is None and len(rows) > 4 * k:
                bar = np.partition(exact, len(exact) - k)[len(exact) - k]
                rows, exact = rows[exact >= bar], exact[exact >= bar]
            order = np.lexsort((self.ids[rows], -exact))[:k]
            yield query_id, self.ids[rows][order], exact[order]

    def rest_at_first(self) -> float:
        return float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1)).max(initial=0))


def _integers(rows: pa.Array | pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * component) of lists, filled with zeros to the longest: 64-bit integers, Python's own beyond."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.diff(rows.offsets.to_numpy())
    flat = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = bool(len(flat)) and np.abs(flat).max() >= 2.0**62
    values = np.array([int(v) for v in flat.tolist()], object) if wide else flat.astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), object if wide else np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _fitting(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(1 << 63) <= int(x) < 1 << 63 for x in scores):
        raise ArithmeticError("a score does not fit 64 bits")
    return scores.astype(np.int64)


def top_k(rows: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``queries`` holds, the k rows of the highest inner product of
    floor(scale * component)."""
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"), queries.alias("asks")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & sound)
    total, asked = part.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = part.select("id", "vector", F.lit(False).alias("asks"), shard.alias("shard"), span(blocks).alias("block"))
    asking = part.filter("asks").select("id", "vector", F.lit(True).alias("asks"), block.alias("block"), span(shards).alias("shard")).select("id", "vector", "asks", "shard", "block")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, vectors = group.column("id").to_numpy(), _integers(group.column("vector"), scale)
        asks = group.column("asks").to_numpy()
        once = []
        for kind in (False, True):
            at = np.flatnonzero(asks == kind)
            order = at[np.lexsort((*vectors[at].T[::-1], ids[at]))] if len(at) else at
            once.append(order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(order) else order)
        kept, wanted = once
        out = list(ImpactIndex(ids[kept], vectors[kept]).search(ids[wanted], vectors[wanted], k)) if len(kept) and len(wanted) else []
        flat = lambda c: np.concatenate([o[c] for o in out]) if out else np.zeros(0)
        return pa.table({"query_id": pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)), "vec_id": pa.array(flat(1).astype(np.int64)), "score": pa.array(_fitting(flat(2)))})

    found = stored.unionAll(asking).groupBy("block", "shard").applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Every row whose id is divisible by ``every`` against all rows."""
    return top_k(embeddings, F.col("vec_id") % every == 0, k)
