"""Media columns: texts stored as TIFF files, and TIFF files read back to a row a page.

Defined results: a null or empty text is 576 bytes of 255; a text of any length is stored whole, over as many pages as
it needs; a null or broken file gives no pages (tiff_pages keeps the reason in a row with page -1).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.tiff import read_pages, write_pages

#: A page is 24 samples wide; payloads fill whole squares of 24 x 24, at most SQUARES of them a page.
SIDE, SQUARES = 24, 2048
#: Files or pages that leave a task in one batch, in bytes.
BATCH_BYTES = 1 << 24


def payload_of(text: str | None) -> bytes:
    """UTF-8, filled with bytes 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // SIDE**2)) * SIDE**2
    return raw.ljust(size, b"\xff")


def file_of(payload: bytes) -> bytes:
    """The payload as grey pages in deflate strips of one page, with the horizontal predictor."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, 1)
    step = SIDE * SQUARES
    return write_pages([rows[i : i + step] for i in range(0, len(rows), step)])


def feature_of(pages: int, payload: np.ndarray) -> str:
    """Pages, height of all of them, mean sample in thousandths, and how many samples lie in each quarter of the range."""
    quarters = np.bincount(payload >> 6, minlength=4)
    return f"pages={pages};size={SIDE}x{len(payload) // SIDE};mean={int(payload.sum(dtype=np.int64)) * 1000 // len(payload)};quarters={'/'.join(map(str, quarters.tolist()))}"


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the TIFF file of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                ids.append(key)
                sizes.append(len((raw or "").encode()))
                files.append(file_of(payload_of(raw)))
                held += len(files[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=names)
                    ids, sizes, files, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=names)

    names = [id_col, "n_bytes", "media"]
    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def tiff_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row a page: id, page, width, height, samples, bits, compression, predictor, pixels (rows laid end to end), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = media.as_py()
                try:
                    for p in read_pages(raw) if raw is not None else ():
                        rows.append((key, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.tobytes(), None))
                        held += p.pixels.nbytes
                        if held >= BATCH_BYTES:
                            yield made(rows, batch)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((key, -1, None, None, None, None, None, None, None, str(e)))
            yield made(rows, batch)

    def made(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.column(0).type, *[pa.int32()] * 7, pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    names = [id_col, "page", "width", "height", "samples", "bits", "compression", "predictor", "pixels", "error"]
    rows = files.select(id_col, media_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string")


def stored_features(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored files of store_documents hold, read back a page at a time: sizes, hashes, the tail's crc, a feature;
    all null for a null file, ValueError for a broken one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                raw = media.as_py()
                if raw is None:
                    rows.append((None,) * 6)
                    continue
                pages = [p.pixels.reshape(-1) for p in read_pages(raw)]
                payload = np.concatenate(pages)
                data = payload.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(len(pages), payload)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = files.select(id_col, "n_bytes", "media")
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
