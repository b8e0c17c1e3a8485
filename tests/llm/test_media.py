import hashlib
import struct
import zlib

import numpy as np
import pytest

from ruleloom.llm import media
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401


def test_round_trip_and_damage():
    for data in (b"", b"a", bytes(range(256)) * 300, b"\0" * 64, b"x" * 65):
        rows, n = media.decode_png(media.encode_png(data))
        assert rows.tobytes() == media.padded(data) and n == len(data) and rows.size % 64 == 0
    png = bytearray(media.encode_png(b"some text " * 50))
    png[60] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"a")[:-3])


def _filter(rows, kinds):
    """Filtered lines straight from the definition of each filter."""
    h, w = rows.shape
    out = np.zeros((h, w + 1), np.uint8)
    for y in range(h):
        out[y, 0] = kinds[y]
        for x in range(w):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) & 255
    return out


def test_every_filter_is_undone():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (60, 64), dtype=np.uint8)
    kinds = rng.integers(0, 5, 60)
    assert (media.unfilter(_filter(rows, kinds)) == rows).all()
    for kind in range(5):
        assert (media.unfilter(_filter(rows, [kind] * 60)) == rows).all()
    with pytest.raises(ValueError):
        media.unfilter(np.full((2, 65), 9, np.uint8))


def test_hash_follows_the_picture():
    rng = np.random.default_rng(1)
    rows = np.cumsum(np.cumsum(rng.normal(size=(200, 64)), 0), 1)
    rows = (255 * (rows - rows.min()) / np.ptp(rows)).astype(np.uint8)
    noisy = (rows.astype(int) + rng.integers(-2, 3, rows.shape)).clip(0, 255).astype(np.uint8)
    bits = lambda r: np.unpackbits(np.frombuffer(media.cosine_hash(r), np.uint8))
    assert (bits(rows) != bits(noisy)).sum() <= 4
    assert (bits(rows) != bits(255 - rows)).sum() > 30


def test_query(spark, docs, folder):
    got = RUN["op10_png_media"](spark, folder(documents=docs)).collect()
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = media.padded(data)
        want.append((r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    assert all(len(r.feature) == 16 and r.media_bytes > 60 for r in got)
    same = [tuple(r) for r in got if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert RUN["op10_png_media"](spark, folder(documents=docs.limit(0))).count() == 0


def test_files_open_by_the_format():
    png = media.encode_png(b"abc" * 100)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (64, 5)
