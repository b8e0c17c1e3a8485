"""Bytes as PNG images in binary columns, with a perceptual hash.

A payload becomes an 8-bit grey image of 64 samples a row. Rows are filtered, deflated
and cut into IDAT chunks; every chunk carries its checksum, which the reader tests.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import map_slices, utf8
from ruleloom.session import cut_lineage

WIDTH = 64
CHUNK_BYTES = 1 << 15
LEVEL = 4
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
LENGTH_KEY = b"payload-length"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """The filter whose residuals are smallest in sum, and the residuals."""
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    found = ((NONE, rows), (SUB, sub), (UP, up))
    return min(found, key=lambda f: int(np.abs(f[1].view(np.int8).astype(np.int16)).sum()))


def padded(data: bytes) -> bytes:
    """The bytes and as many zeros as make them a positive multiple of the row width."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def encode_png(data: bytes) -> bytes:
    payload = padded(data)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    kind, residuals = _filtered(rows)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = residuals
    packed = zlib.compress(lines.tobytes(), LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    parts.append(_chunk(b"tEXt", LENGTH_KEY + b"\0" + str(len(data)).encode()))
    parts += [_chunk(b"IDAT", packed[i : i + CHUNK_BYTES]) for i in range(0, len(packed), CHUNK_BYTES)]
    parts.append(_chunk(b"IEND", b""))
    return b"".join(parts)


def chunks(png: bytes) -> list[tuple[bytes, bytes]]:
    """The chunks of a file; a wrong signature, checksum or end raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, out = 8, []
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the last chunk is cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        crc = png[at + 8 + size : at + 12 + size]
        if len(data) != size or len(crc) != 4 or zlib.crc32(kind + data) != int.from_bytes(crc, "big"):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        out.append((kind, data))
        at += 12 + size
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND":
        raise ValueError("the file does not run from IHDR to IEND")
    return out


def _paeth_row(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = line.copy(), 0, 0
    for i in range(len(line)):
        b = int(above[i])
        base = left + b - corner
        gaps = (abs(base - left), abs(base - b), abs(base - corner))
        pick = (left, b, corner)[gaps.index(min(gaps))]
        left = out[i] = (int(line[i]) + pick) & 255
        left, corner = int(left), b
    return out


def _average_row(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = line.copy(), 0
    for i in range(len(line)):
        left = (int(line[i]) + (left + int(above[i])) // 2) & 255
        out[i] = left
    return out


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines; runs of one simple filter are undone as a whole."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds.astype(np.int16))) + 1).tolist(), len(kinds)]
    for lo, hi in zip(edges, edges[1:]):
        kind = kinds[lo] if hi > lo else NONE
        if kind == SUB:
            rows[lo:hi] = np.cumsum(rows[lo:hi], axis=1, dtype=np.uint8)
        elif kind == UP:
            if lo:
                rows[lo] += rows[lo - 1]
            rows[lo:hi] = np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            undo = _average_row if kind == AVERAGE else _paeth_row
            for i in range(lo, hi):
                rows[i] = undo(rows[i], rows[i - 1] if i else np.zeros_like(rows[i]))
        elif kind != NONE:
            raise ValueError(f"unknown filter {kind}")
    return rows


def decode_png(png: bytes) -> tuple[np.ndarray, int]:
    """The samples of an 8-bit grey image, and the length kept beside them."""
    parts = chunks(png)
    width, height, depth, colour, packing, filters, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, packing, filters, interlace) != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    data = zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT"))
    if len(data) != height * (width + 1):
        raise ValueError("the image data has another size than its header says")
    rows = unfilter(np.frombuffer(data, np.uint8).reshape(height, width + 1))
    notes = dict(d.split(b"\0", 1) for k, d in parts if k == b"tEXt")
    return rows, int(notes.get(LENGTH_KEY, height * width))


def _cosines(size: int, keep: int) -> np.ndarray:
    k, n = np.arange(keep)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * size))


GRID, LOW = 32, 8
COSINES = _cosines(GRID, LOW)


def _fit(rows: np.ndarray, size: int) -> np.ndarray:
    """Rows averaged down to `size` bins, or repeated up to it."""
    n = len(rows)
    if n <= size:
        return rows[np.arange(size) * n // size]
    edges = np.arange(size) * n // size
    return np.add.reduceat(rows, edges, axis=0) / np.diff([*edges, n])[:, None]


def cosine_hash(rows: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients exceed their median."""
    grid = _fit(_fit(rows.astype(np.float64), GRID).T, GRID).T
    low = np.round(COSINES @ grid @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(_: object, ids: list, texts: list) -> dict:
    return {"doc_id": ids, "media": [encode_png(utf8(t)) for t in texts]}


def _read(_: object, ids: list, media: list) -> dict:
    out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash")}
    for doc_id, png in zip(ids, media):
        rows, n = decode_png(png)
        payload = rows.tobytes()
        row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(rows))
        for values, value in zip(out.values(), row):
            values.append(value)
    return out


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every text as a PNG file in a binary column, written to the shared folder.

    A null text is an empty payload, which is one row of zeros. Repeated rows, null ids
    and equal texts each keep a row of their own; other columns are not read; an empty
    table gives an empty one. A text is one value, so its image is built in one task.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return cut_lineage(map_slices(rows, _encode, "doc_id long, media binary", 1))


def read_media(media: DataFrame) -> DataFrame:
    """Decode stored images: sizes, digests of the samples and of the file, binary hash.

    Chunk checksums, the deflate checksum and the image size are tested; a damaged
    file raises an error.
    """
    return map_slices(
        media.select("doc_id", "media"),
        _read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary",
        1,
    )
