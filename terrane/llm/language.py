"""Language ID by a byte convolutional network, trained here in numpy.

Bytes (A-Z lower-cased) are embedded; filters of widths 2, 3 and 4 run over windows of fixed length; each filter's
largest response in a window goes through a rectifier to a softmax layer. A text is all its windows: their log
probabilities are averaged by the bytes they hold. For use the embedding and the filters are multiplied out to tables of
byte pairs, so a response is a sum of one or two table rows.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; equal texts give
equal rows; labels that are null are not used; only id and text are read to predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.quality import bucket_of, sampled
from terrane.llm.text import bytes_of, lean, lower_ascii, slices

#: Bytes of a window, and the most labelled rows of each language that a network is fitted on (SLICE characters of each).
WINDOW, SAMPLE_PER_CLASS, SLICE = 256, 1500, 768
EMBEDDING, FILTERS, WIDTHS = 6, 12, (2, 3, 4)
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.004, 1e-5
#: Bytes of text that are taken through the tables at a time.
PASS_BYTES = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (bytes, 0 beyond a text's end), the row that each belongs to, and its number of bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    held = np.minimum(sizes[owner] - first, WINDOW)
    at = (offsets[owner] + first)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8), owner, held


@dataclass
class Network:
    names: list[str]
    tables: list[np.ndarray]  # pair tables for widths 2, 3 (and its byte table), 4 (first and second pair)
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        two, three, third, front, back = self.tables
        pairs = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
        best = [np.take(two, pairs, 0).max(1), (np.take(three, pairs[:, :-1], 0) + np.take(third, windows[:, 2:], 0)).max(1), (np.take(front, pairs[:, :-2], 0) + np.take(back, pairs[:, 2:], 0)).max(1)]
        hidden = np.maximum(np.concatenate(best, 1) + self.bias, 0)
        logits = hidden @ self.dense + self.shift
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its probability for each text (0 and 0 for an empty one)."""
        pick, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for first, end, part, at in slices(data, offsets, PASS_BYTES):
            total, weight = np.zeros((end - first, len(self.names))), np.zeros(end - first)
            part = lower_ascii(part)
            for w in range(0, max(1, len(part)), 4 * PASS_BYTES):
                # Only a text longer than a pass is cut, at a multiple of the window.
                cut = np.clip(at, w, w + 4 * PASS_BYTES) - w
                windows, owner, held = windows_of(part[w : w + 4 * PASS_BYTES], cut)
                for i in range(0, len(windows), 1024):
                    found = self.log_probabilities(windows[i : i + 1024]) * held[i : i + 1024, None]
                    np.add.at(total, owner[i : i + 1024], found)
                    np.add.at(weight, owner[i : i + 1024], held[i : i + 1024])
            mean = total / np.maximum(weight, 1)[:, None]
            share = np.exp(mean - mean.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            pick.append(share.argmax(1))
            score.append(np.where(weight > 0, share.max(1), 0.0))
        return np.concatenate(pick), np.concatenate(score)


def fit(texts: list[bytes], labels: list[str], seed: int = 3) -> Network:
    """Trains by Adam on the windows of the texts; gradients flow through each filter's largest response."""
    names = sorted(set(labels))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, owner, held = windows_of(lower_ascii(joined), offsets)
    x, y = x[held >= 16], np.array([names.index(v) for v in labels])[owner[held >= 16]]
    rng = np.random.default_rng(seed)
    params = {"emb": rng.normal(0, 0.5, (256, EMBEDDING)), "dense": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names))), "shift": np.zeros(len(names)), "bias": np.zeros(FILTERS * len(WIDTHS))}
    params |= {f"w{w}": rng.normal(0, 0.5 / np.sqrt(w), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    balance = len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            bytes_, goal = x[rows], y[rows]
            lanes, grads = np.arange(len(rows))[:, None], {k: np.zeros_like(v) for k, v in params.items()}
            embedded, picked, best = params["emb"][bytes_], [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                patches = np.concatenate([embedded[:, j : j + n] for j in range(w)], 2)
                response = patches @ params[f"w{w}"]
                top = response.argmax(1)
                best.append(np.take_along_axis(response, top[:, None], 1)[:, 0])
                picked.append((w, top, patches[lanes, top]))
            before = np.concatenate(best, 1) + params["bias"]
            hidden = np.maximum(before, 0)
            logits = hidden @ params["dense"] + params["shift"]
            share = np.exp(logits - logits.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            share[np.arange(len(rows)), goal] -= 1
            share *= (balance[goal] / len(rows))[:, None]
            grads["dense"], grads["shift"] = hidden.T @ share, share.sum(0)
            back = (share @ params["dense"].T) * (before > 0)
            grads["bias"] = back.sum(0)
            for k, (w, top, patch) in enumerate(picked):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[f"w{w}"] = np.einsum("bf,bfe->ef", g, patch)
                into = np.einsum("bf,ef->bfe", g, params[f"w{w}"]).reshape(len(rows), FILTERS, w, EMBEDDING)
                for j in range(w):
                    np.add.at(grads["emb"], bytes_[lanes, top + j], into[:, :, j])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = (params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return compiled(params, names)


def compiled(params: dict[str, np.ndarray], names: list[str]) -> Network:
    at = lambda w, j: params["emb"] @ params[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING]
    pair = lambda w, j: (at(w, j)[:, None] + at(w, j + 1)[None]).reshape(65536, FILTERS).astype(np.float32)
    tables = [pair(2, 0), pair(3, 0), at(3, 2).astype(np.float32), pair(4, 0), pair(4, 2)]
    return Network(names, tables, params["bias"], params["dense"], params["shift"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fits on a slice, at a hashed place, of at most about SAMPLE_PER_CLASS documents of each language."""
    rows = docs.select(id_col, text_col, F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col(text_col).isNotNull())
    chosen, totals = sampled(rows, id_col, "lang", SAMPLE_PER_CLASS)
    if not totals:
        return None
    place = F.pmod(F.xxhash64(F.lit("place"), F.col(id_col)), F.greatest(F.char_length(text_col) - SLICE, F.lit(0)).cast("long") + 1) + 1
    got = chosen.select(F.col(id_col).cast("string").alias("id"), F.substring(F.col(text_col), place.cast("int"), F.lit(SLICE)).alias("part"), "lang").limit(2 * SAMPLE_PER_CLASS * len(totals)).toArrow().sort_by([("id", "ascending"), ("part", "ascending")])
    return fit([t.encode() for t in got.column("part").to_pylist()], got.column("lang").to_pylist())


def lettered(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: at once for A-Z and a-z, by character for the few others."""
    ascii_ = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
    found = np.diff(ascii_) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def predict_documents(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            known = lettered(batch.column(1), data, offsets)
            if net is None:
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                pick, score = net.predict(data, offsets)
                lang = [net.names[p] if k else "und" for p, k in zip(pick.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], names=[id_col, "lang_pred", "score"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows of fold ``held`` are not learned from."""
    network = train(docs.filter(bucket_of(id_col, folds) != held), id_col, text_col, lang_col)
    found = predict_documents(docs, network, id_col, text_col)
    return found.select(id_col, (bucket_of(id_col, folds) == held).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, network: Network | None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, columns unchanged, that have a letter and whose language has a probability of at least ``least``;
    all that have a letter if nothing was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            data, offsets = bytes_of(batch.column(at))
            keep = lettered(batch.column(at), data, offsets)
            if net is not None:
                keep &= net.predict(data, offsets)[1] >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
