"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a sequence of words (runs of letters, of digits, or of other signs). Three streams of n-grams are hashed to
one table of weights: single words, word pairs (a repeated word gives one common pair), and triples of word shapes
(kind, case, length, whether white space stands before). A stream's values are its counts divided by its size, so a
score is the sparse dot product of counts and weights. Labels come from a bounded, hashed sample of labelled rows.

Defined results: null and empty texts score the bias alone; without labels of both classes every score is the share of
label 1 (0.5 without labels); labels that are null are not used; repeated rows give equal scores; other columns of
the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import bytes_of, lean, lower_ascii, mix, slices, word_hashes

#: Bits of the weight table (4 bytes a weight), and the most labelled rows of each class that a model is fitted on.
TABLE_BITS, SAMPLE_PER_CLASS = 20, 3000
#: Weight of a stream's counts, and the settings of the updates.
SCALE, ALPHA, BETA, L1, L2, EPOCHS = 6.0, 0.3, 1.0, 0.002, 0.01, 4

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts of one slice: row, weight index and value of every n-gram (indices repeat)."""
    n, rows = len(data), len(offsets) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not n:
        return none
    kind = _KIND[data]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, kind[1:] != kind[:-1]
    edge[offsets[offsets < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    kinds = kind[starts]
    spaced = np.empty(len(starts), bool)
    spaced[0], spaced[1:] = True, kinds[:-1] == 0
    words = kinds != 0
    starts, ends, kinds, spaced = starts[words], ends[words], kinds[words].astype(np.uint64), spaced[words]
    if not len(starts):
        return none
    owner = np.searchsorted(offsets, starts, "right") - 1
    hashes = word_hashes(lower_ascii(data), starts, ends)
    hashes[kinds == 2] = 7
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals, size = upper[ends] - upper[starts], ends - starts
    case = np.where(capitals == 0, 0, np.where((capitals == size) & (size > 1), 2, np.where((capitals == 1) & _UPPER[data[starts]], 1, 3))).astype(np.uint64)
    length = np.minimum(np.ceil(np.log2(size)), 5).astype(np.uint64)
    signs = np.where(kinds == 3, hashes, np.uint64(0))
    shape = mix((((kinds * np.uint64(4) + case) * np.uint64(8) + length) * np.uint64(2) + spaced) ^ signs)
    pair = np.where(hashes[1:] == hashes[:-1], np.uint64(11), mix(hashes[:-1] * np.uint64(3) + hashes[1:] + np.uint64(1)))
    triple = mix(shape[:-2] * np.uint64(5) + shape[1:-1] * np.uint64(3) + shape[2:] + np.uint64(2))
    streams = [(owner, hashes), (owner[1:][owner[1:] == owner[:-1]], pair[owner[1:] == owner[:-1]]), (owner[2:][owner[2:] == owner[:-2]], triple[owner[2:] == owner[:-2]])]
    row = np.concatenate([o for o, _ in streams])
    index = np.concatenate([h >> np.uint64(64 - TABLE_BITS) for _, h in streams]).astype(np.int64)
    value = np.concatenate([(SCALE / np.maximum(np.bincount(o, minlength=rows), 1))[o] for o, _ in streams])
    return row, index, value


def gathered(row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct indices and summed values of each row."""
    key, inverse = np.unique((row << TABLE_BITS) | index, return_inverse=True)
    sums = np.bincount(inverse, value, len(key))
    cuts = np.searchsorted(key >> TABLE_BITS, np.arange(rows + 1))
    index = key & ((1 << TABLE_BITS) - 1)
    return [(index[a:b], sums[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes over the rows, each in an order of its own."""
    size = 1 << TABLE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            index, value = np.append(rows[k][0], size), np.append(rows[k][1], 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - labels[k]) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w[:size].astype(np.float32), float(w[size])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for first, end, part, at in slices(data, offsets):
            row, index, value = features(part, at)
            logits = np.bincount(row, self.weights[index] * value, end - first) + self.bias
            parts.append(1 / (1 + np.exp(-np.clip(logits, -35, 35))))
        return np.concatenate(parts)


def bucket_of(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(buckets))


def sampled(rows: DataFrame, id_col: str, class_col: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each class at most, chosen by the id's hash, and the number of rows of each class."""
    totals = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    share = F.lit(0.0)
    for value, n in totals.items():
        share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    dealt = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30))
    return rows.filter(dealt < share * F.lit(1 << 30)), totals


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most about SAMPLE_PER_CLASS labelled rows of each class; labels not null, joined by id."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
    chosen, totals = sampled(known, id_col, "label", SAMPLE_PER_CLASS)
    if len(totals) < 2:
        share = float(next(iter(totals), 0.5))
        return Model(np.zeros(1 << TABLE_BITS, np.float32), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            rows = [r for first, end, part, at in slices(data, offsets) for r in gathered(*features(part, at), end - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))], names=["id", "label", "index", "value"])

    # The sample is bounded, so it can go to every task; the documents are not shuffled.
    joined = docs.select(id_col, text_col).join(F.broadcast(chosen.limit(4 * SAMPLE_PER_CLASS)), id_col).select(id_col, text_col, "label")
    got = joined.mapInArrow(run, "id string, label int, index array<int>, value array<float>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = got.column("label").to_numpy()
    rows = [(i.values.to_numpy(), v.values.to_numpy().astype(np.float64)) for i, v in zip(got.column("index"), got.column("value"), strict=True)]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0)
    weights, bias = follow_the_leader(rows, y)
    # The classes were sampled at different rates: the bias is moved back to their real odds.
    return Model(weights, bias + float(np.log(totals[1] / totals[0]) - np.log((y == 1).sum() / (y == 0).sum())))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents, columns unchanged, whose score is at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.score(*bytes_of(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_labelled_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of fold 0 give no labels."""
    model = train(docs, labels.filter(bucket_of(id_col, folds) != 0), id_col, text_col)
    scored = score_ids(docs, model, id_col, text_col)
    return scored.select(id_col, (bucket_of(id_col, folds) == 0).alias("held_out"), "score", "predicted")


def score_ids(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted: the text does not leave the worker."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(*bytes_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, score double, predicted int")
