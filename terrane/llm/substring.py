"""Substring dedup: words covered by a window of consecutive words that a document of smaller id holds too.

Exact copies are found by digest; each copy but the first is covered whole. The others are cut at content-defined
anchors: a window's key is the least hash of its word n-grams, so equal windows have equal keys wherever they stand.
Keys that one document alone holds cannot repeat and go no further. Runs of windows with one key are segments. They are
dealt to shards by key; each shard builds a compressed FM-index of its distinct segments, and streams the pieces of
documents dealt to it through backward search over its wavelet matrix: places whose matching statistic reaches a window
are reported with the smallest document that holds the run. The outcome is joined to the segments' occurrences,
gathered by document, and taken out of its text.

Keys of more than HOT documents, or that many documents of one task share, are cut into single windows, dealt by the
window's digest, so that a passage that very many documents share does not gather in one shard; equal segments are put
together before they are shuffled, and a task sends one row of a key that it found crowded to where keys meet.

Segments are joined by a digest of 128 bits, words in an index are told apart by two hashes of 64 bits each.

Defined results: null, empty and short texts (fewer words than a window) lose nothing; of equal texts only the smallest
id keeps its windows; equal ids count as one document for the comparison of ids (none is smaller), and each of their
texts loses its own windows; blank runs between kept words become single spaces in documents that lose words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.fm_index import FmIndex
from terrane.llm.tables import apart, dropped, salted_join, settled, written
from terrane.llm.text import bytes_of, crowded, gram_hashes, gram_owner, lean, slices, trimmed, word_hashes, word_spans

#: Words of a window, and of the n-grams of which a window's key is the least.
WINDOW, GRAM = 13, 5
#: Documents that share a key before its segments are cut to windows, those of one task alone; words of a shard.
HOT, HOT_HERE, SHARD_WORDS = 1000, 256, 400_000
#: Ids up to which a side is sent to all tasks (16 bytes each).
MOST_IDS = 1_000_000
#: Keys that a task holds before they go on; words of documents that are streamed at once.
HELD, STREAMED = 1 << 18, 1 << 16


def window_keys(hashes: np.ndarray, words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, row and key of every window of the texts of a slice."""
    owner = gram_owner(words, window)
    start = np.flatnonzero(owner >= 0)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, gram)
    least = grams[: len(grams) - (window - gram)].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, grams[j : len(grams) - (window - gram) + j], out=least)
    return start, owner[start], least[start]


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def keys_of(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, key, weight: the distinct keys of each text; weight is that of ``crowded``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def passed() -> pa.RecordBatch:
            ids, keys = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.view(np.int64)), pa.array(crowded(keys, HOT_HERE))], names=["doc", "key", "weight"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, at in slices(*bytes_of(batch.column(1))):
                starts, ends, words = word_spans(data, at)
                _, row, key = window_keys(word_hashes(data, starts, ends), words, window, gram)
                change = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
                row, key = row[change], key[change]
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                once = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
                held.append((ids[first + row[once]], key[once]))
                size += len(held[-1][0])
                if size >= HELD:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    return docs.select("doc", "text").mapInArrow(run, "doc long, key long, weight int")


def shared_keys(keys: DataFrame) -> DataFrame:
    """doc, key, hot of the keys that several documents share."""
    # One exchange for all four: the part is a column before the windows see it.
    key, part = apart("key", "doc")
    group = Window.partitionBy("key", "part")
    counted = keys.withColumn("part", part).select("doc", key, "weight", "part", F.min("doc").over(group).alias("low"), F.max("doc").over(group).alias("high"), F.sum("weight").over(group).alias("n"), F.max("weight").over(group).alias("most"))
    crowd = (F.col("weight") == 0) | (F.col("most") > 1)
    return counted.filter(crowd | (F.col("low") < F.col("high"))).select("doc", "key", (crowd | (F.col("n") > HOT)).alias("hot"))


def segments_of(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """key, segment (words joined by one space), name (its digest), doc, mark, at (first word): the runs of windows whose
    key is among the document's repeated ones. rows: doc, mark, text, keys, hot (those of the keys that are cut to windows)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks, keys, hot = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3), batch.column(4)
            for first, end, data, at in slices(*bytes_of(batch.column(1)), 1 << 20):
                starts, ends, words = word_spans(data, at)
                hashes = word_hashes(data, starts, ends)
                start, row, key = window_keys(hashes, words, window, gram)
                wanted, single = np.zeros(len(key), bool), np.zeros(len(key), bool)
                cuts = np.searchsorted(row, np.arange(end - first + 1))
                for i in range(end - first):
                    span = slice(cuts[i], cuts[i + 1])
                    wanted[span] = np.isin(key[span], keys[first + i].values.to_numpy().view(np.uint64))
                    if len(hot[first + i]):
                        single[span] = np.isin(key[span], hot[first + i].values.to_numpy().view(np.uint64))
                start, row, key, single = start[wanted], row[wanted], key[wanted], single[wanted]
                if not len(start):
                    continue
                opens = np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | single[1:])
                begin = np.flatnonzero(opens)
                last = np.append(begin[1:], len(start)) - 1
                low, high = start[begin], start[last] + window
                # Texts with one space between words: bytes of words, and of the blank before each word but the first.
                inside = np.zeros(len(data) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                keep = np.cumsum(inside[:-1]) > 0
                blank = starts[starts > 0] - 1
                blank = blank[~keep[blank]]
                keep[blank] = True
                plain = data.copy()
                plain[blank] = 32
                place = np.concatenate([[0], np.cumsum(keep)])
                plain = plain[keep].tobytes()
                left, right = place[starts[low]].tolist(), place[ends[high - 1]].tolist()
                # Windows that are cut single are dealt by their own digest.
                segments = [plain[x:y] for x, y in zip(left, right, strict=True)]
                name = [hashlib.blake2b(x, digest_size=16).digest() for x in segments]
                own = np.frombuffer(b"".join(name), np.int64)[::2]
                shard_key = np.where(single[begin], own, key[begin].view(np.int64))
                columns = [pa.array(shard_key), pa.array(segments, pa.binary()), pa.array(name, pa.binary()), pa.array(ids[first + row[begin]], pa.int64()), pa.array(marks[first + row[begin]], pa.int64()), pa.array(low - words[row[begin]], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "segment", "name", "doc", "mark", "at"])

    return rows.select("doc", "text", "mark", "keys", "hot").mapInArrow(run, "key long, segment binary, name binary, doc long, mark long, at int")


def searched(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """key, name, least: for each distinct segment the smallest document of each of its windows, if one is smaller than
    the largest document of the segment. distinct: key, name, segment, low, high (its smallest and largest document)."""

    def run(group: pa.Table) -> pa.Table:
        data, offsets = bytes_of(group.column("segment"))
        starts, ends, words = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends), word_hashes(data, starts, ends, 1)
        index = FmIndex(hashes, words, group.column("low").to_numpy(), window)
        high = group.column("high").to_numpy()
        useful, least, sizes = [], [], []
        # Pieces of documents are streamed through the index a part at a time.
        for first, end, _, _ in slices(data, words, STREAMED):
            a, b = words[first], words[end]
            place, owner = index.covered((hashes[0][a:b], hashes[1][a:b]), words[first : end + 1] - a)
            row = np.searchsorted(words[first : end + 1] - a, place, "right") - 1
            cuts = np.searchsorted(row, np.arange(end - first))
            smaller = np.flatnonzero(np.minimum.reduceat(owner, cuts) < high[first:end]) if len(owner) else np.zeros(0, np.int64)
            useful.append(first + smaller)
            least.append(owner[np.isin(row, smaller)])
            sizes.append(np.bincount(row, minlength=end - first)[smaller])
        chosen = np.concatenate([*useful, np.zeros(0, np.int64)]).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32()), pa.array(np.concatenate([*least, np.zeros(0, np.int64)]), pa.int64()))
        del index, hashes, starts, ends, data
        trimmed()
        return pa.table({"key": group.column("key").take(pa.array(chosen)), "name": group.column("name").take(pa.array(chosen)), "least": lists})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "key long, name binary, least array<bigint>")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[tuple[DataFrame, str], tuple[DataFrame, str]]:
    """The tables (doc, mark, starts): first words of the windows that a smaller document holds, for texts that have any
    and are not copies; and (doc, mark): the copies, which are covered whole. docs: doc (long), mark, text."""
    spark, docs = docs.sparkSession, docs.filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    digests = docs.select("doc", "mark", F.unhex(F.sha2("text", 256)).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = written(salted_join(digests, firsts, "digest", "doc", "inner").filter("doc > first").select("doc", "mark").distinct())
    single = _without(docs, copies[0], copies[0].count())
    shared, shared_at = written(shared_keys(keys_of(single, window, gram)))
    settled(spark)
    wanted, wanted_at = written(shared.groupBy("doc").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot")))
    dropped(spark, shared_at)
    n = wanted.count()
    chosen = single.join(F.broadcast(wanted.select("doc")) if n <= MOST_IDS else wanted.select("doc"), "doc", "left_semi")
    found, found_at = written(segments_of(chosen.join(wanted, "doc"), window, gram))
    dropped(spark, wanted_at)
    settled(spark)
    distinct = found.groupBy("key", "name", "segment").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    size = found.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    least = searched(distinct, max(1, -(-size // (6 * SHARD_WORDS))), window)
    covered = found.select("key", "name", "doc", "mark", "at").join(least, ["key", "name"])
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc"), F.col("at") + i)), lambda x: x.isNotNull())
    out = written(covered.select("doc", "mark", starts.alias("starts")).filter(F.size("starts") > 0).groupBy("doc", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    dropped(spark, found_at)
    settled(spark)
    return out, copies


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= MOST_IDS else rows


def _without(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Documents that are not among the (doc, mark) of ``ids``, which go to all tasks if they are few."""
    return docs.join(_small(ids, n), ["doc", "mark"], "left_anti") if n else docs


def kept_words(text: str, starts: np.ndarray | None, whole: bool, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept ones joined by one space."""
    raw = text.encode()
    words = raw.split()
    # bytes.split() cuts at the same six bytes as the pattern of words does.
    gone = np.zeros(len(words) + 1, np.int32)
    if whole and len(words) >= window:
        return len(words), len(words), b""
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words)
    starts = starts[starts <= len(words) - window]
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay.tolist()])


def with_marks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> list[DataFrame]:
    """row (the document, its columns as they are), doc, starts, whole of the documents, in up to three parts: those that
    lose windows, copies, the rest."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"))
    (marks, _), (copies, _) = repeated_windows(rows.select("doc", "mark", F.col("row.text").alias("text")), window, gram)
    none, yes, no = F.lit(None).cast("array<int>"), F.lit(True), F.lit(False)
    n, m = marks.count(), copies.count()
    parts, rest = [], rows
    if n:
        touched = rows.join(_small(marks.select("doc", "mark"), n), ["doc", "mark"], "left_semi")
        parts.append(touched.join(marks, ["doc", "mark"]).withColumn("whole", no))
        rest = _without(rest, marks.select("doc", "mark"), n)
    if m:
        parts.append(rows.join(_small(copies, m), ["doc", "mark"], "left_semi").withColumn("starts", none).withColumn("whole", yes))
        rest = _without(rest, copies, m)
    return [*parts, rest.withColumn("starts", none).withColumn("whole", no)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _starts(column: pa.Array, i: int) -> np.ndarray | None:
    return column[i].values.to_numpy(zero_copy_only=False) if column[i].is_valid else None


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, whole = batch.column(2), batch.column(3).to_pylist()
            rows = [kept_words(batch.column(1)[i].as_py() or "", _starts(starts, i), whole[i], window) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select("doc_id", "text")
    kind = f"doc_id {_kind(rows, 'doc_id')}, n_words long, n_removed long, kept_sha256 string"
    return _union([p.select("row.doc_id", "row.text", "starts", "whole").mapInArrow(run, kind) for p in with_marks(rows, window)])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their columns, whatever they are called; texts that lose words hold the kept ones, joined by
    one space."""
    place = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            starts, whole = batch.column(1), batch.column(2).to_pylist()
            texts = columns[place].to_pylist()
            for i, text in enumerate(texts):
                if text is not None and (whole[i] or starts[i].is_valid):
                    _, removed, kept = kept_words(text, _starts(starts, i), whole[i], window)
                    texts[i] = kept.decode() if removed else text
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return _union([p.select("row", "starts", "whole").mapInArrow(run, docs.schema) for p in with_marks(docs, window)])
