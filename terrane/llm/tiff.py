"""TIFF files: a reader for grey, RGB and multi-sample pages in strips or tiles, and a lossless writer.

The reader walks the chain of image directories, decodes PackBits, LZW and deflate data, undoes the horizontal
predictor, and gives one array a page. All sizes come from the file, so each is checked against the data.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: tags, compressions, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PAGE, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 284, 297, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """Runs and literals, until ``most`` bytes are there."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as a count and a byte, all else as literal stretches of at most 128 bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    edges = np.flatnonzero(np.diff(raw)) + 1
    starts, out, literal = np.concatenate([[0], edges]), bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for start, end in zip(starts.tolist(), [*edges.tolist(), len(raw)], strict=True):
        n = end - start
        if n < 3:
            literal += data[start:end]
            continue
        flush()
        while n:
            part = min(n, 128)
            if part == 1:
                literal += data[end - 1 : end]
            else:
                out.append(257 - part)
                out.append(data[start])
            n -= part
    flush()
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widening one code early, until ``most`` bytes are there."""
    out, table, previous = bytearray(), [], b""
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        if most is not None and len(out) >= most:
            break
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    put(256)
    following, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


#: How many bytes a byte of compressed data can stand for at most.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2736, DEFLATE: 1033, OLD_DEFLATE: 1033}


def _unpack(data: bytes, compression: int, need: int) -> bytes:
    """The first ``need`` bytes that the data stands for, or fewer if there are fewer: no more than is asked for is made."""
    if compression == NONE:
        return data[:need]
    try:
        if compression in (DEFLATE, OLD_DEFLATE):
            return zlib.decompressobj().decompress(data, need)
        if compression == PACKBITS:
            return unpack_bits(data, need)
        if compression == LZW:
            return unpack_lzw(data, need)
    except (zlib.error, IndexError) as e:
        raise ValueError(f"broken data: {e}") from e
    raise ValueError(f"compression {compression} is not read")


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise ValueError("a directory lies outside the file")
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPE_CODES:
                continue
            size, where = TYPE_BYTES[kind] * count, at + 10 + 12 * k
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + size > len(data):
                raise ValueError("a tag's values lie outside the file")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages in file order; ValueError for what is broken or not read (such as samples of unequal or odd size)."""
    for index, (order, tags) in enumerate(_directories(data)):
        one = lambda tag, other, tags=tags: (tags.get(tag) or [other])[0]
        if any(v < 0 for values in tags.values() for v in values):
            raise ValueError("a tag with a negative value")
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        bits, compression, predictor, planes = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), 1
        if set(tags.get(BITS, [1])) not in ({8}, {16}) or predictor not in (1, 2) or one(FORMAT, 1) != 1:
            raise ValueError("only unsigned samples of 8 or 16 bits are read")
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
        offsets, sizes = (tags[TILE_OFFSETS], tags.get(TILE_SIZES, [])) if tiled else (tags.get(STRIP_OFFSETS, []), tags.get(STRIP_SIZES, []))
        depth = samples
        if one(PLANAR, 1) == 2:
            planes, depth = samples, 1
        if not (width and height and across and down):
            raise ValueError("a page without size")
        columns, lines = -(-width // across), -(-height // down)
        if len(offsets) < planes * columns * lines or len(sizes) < len(offsets):
            raise ValueError("a page lacks strips or tiles")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        # Before a page is made room for, whether the file can hold it at all.
        held = sum(min(size, len(data)) for size in sizes[: planes * columns * lines])
        if compression not in EXPANSION:
            raise ValueError(f"compression {compression} is not read")
        if width * height * samples * kind.itemsize > held * EXPANSION[compression]:
            raise ValueError("a page is larger than its data can be")
        if across * down * depth * kind.itemsize > len(data) * EXPANSION[compression]:
            raise ValueError("a tile is larger than its data can be")
        pixels = np.empty((height, width, samples), kind.newbyteorder("="))
        for k in range(planes * columns * lines):
            plane, rest = divmod(k, columns * lines)
            line, column = divmod(rest, columns)
            top, left = line * down, column * across
            rows = down if tiled else min(down, height - top)
            need = rows * across * depth * kind.itemsize
            got = _unpack(data[offsets[k] : offsets[k] + sizes[k]], compression, need)
            if len(got) < need:
                raise ValueError("a strip or tile is too short")
            part = np.frombuffer(got[:need], kind).reshape(rows, across, depth)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=pixels.dtype)
            high, wide = min(rows, height - top), min(across, width - left)
            to = slice(plane, plane + 1) if planes > 1 else slice(None)
            pixels[top : top + high, left : left + wide, to] = part[:high, :wide]
        yield Page(index, width, height, samples, bits, compression, predictor, pixels)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, rows: int | None = None, level: int = 1, order: str = "<") -> bytes:
    """A file of 8-bit or 16-bit pages (height x width x samples), in strips of ``rows`` rows or in tiles (height, width)."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for index, page in enumerate(pages):
        height, width, samples = page.shape
        kind = np.dtype(np.uint8) if page.dtype == np.uint8 else np.dtype(order + "u2")
        down, across = tile or (rows or height, width)
        offsets, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                part = page[top : top + down, left : left + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = np.ascontiguousarray(part.astype(kind, copy=False)).tobytes()
                coded = raw if compression == NONE else pack_bits(raw) if compression == PACKBITS else pack_lzw(raw) if compression == LZW else zlib.compress(raw, level)
                offsets.append(len(out))
                sizes.append(len(coded))
                out += coded
        out += b"\0" * (len(out) % 2)
        tags: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * kind.itemsize] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PAGE, 3, [index & 65535, min(len(pages), 65535)]), (PREDICTOR, 3, [predictor]),
        ]
        tags += [(TILE_WIDTH, 4, [across]), (TILE_HEIGHT, 4, [down]), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS, 4, [down]), (STRIP_SIZES, 4, sizes)]
        entries = []
        for tag, code, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{TYPE_CODES[code]}", *values)
            if len(packed) > 4:
                where = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, code, len(values)) + packed.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)
