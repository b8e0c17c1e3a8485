import base64
import hashlib

import pytest
import zstandard

from ruleloom.llm import warc
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401


def _sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "lorem ipsum " * 40000
    rows = [(1, "http://a/1", "<p>x"), (2, None, None), (3, "http://a\r\nX: y", ""), (4, "http://a/4", "<p>x"), (5, "u", long), (6, "u", long),
            (7, "u", "größe 日本"), (8, "u", "<p>x"), (9, "u", "lone"), (9, "u", "lone"), (None, "u", "<p>x"), (None, "u", "only without id"), (None, "u", "only without id")]
    rows += [(100 + i, "u", f"page {i % 7}") for i in range(300)]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, frame int")


def _want(pages, least=0):
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    last = {}
    for i, t in rows:
        if i is not None:
            last[t] = max(i, last.get(t, i))
    out = []
    for i, t in rows:
        to = last.get(t)
        revisit = len(t.encode()) >= least and to is not None and to != i
        out.append((i, len(t.encode()), _sha(t), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, pages, folder):
    got = RUN["op3_seekable_warc"](spark, folder(pages=pages))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == _want(pages)
    assert RUN["op3_seekable_warc"](spark, folder(pages=pages.limit(0))).count() == 0


def test_shorter_payloads_are_responses_and_frames_are_small(spark, pages):
    stored = warc.write_bundles(pages, min_payload=6, frame_bytes=500, bundle_bytes=2000)
    assert sorted((tuple(r)[:5] for r in warc.read_bundles(stored).collect()), key=str) == _want(pages, 6)
    files = stored.collect()
    assert len(files) > 1 and len({f.bundle for f in files}) == len(files)
    by_place = {}
    for f in files:
        table = warc.seek_table(f.data)
        whole = b"".join(zstandard.ZstdDecompressor().decompress(f.data[at : at + size]) for at, size, _, _ in table)
        assert whole.count(b"WARC/1.1\r\n") == len(f.records)  # every frame stands alone
        for r in f.records:
            by_place.setdefault(r.page_id, []).append(warc.parse(warc.frame(f.data, table[r.frame])[r.start : r.start + r.length])[2])
    assert by_place[8] == [b"<p>x"]
    assert warc.places(stored).count() == pages.count()


def test_damage_is_found(spark):
    bundle = warc.Bundle(1000, 3)
    bundle.add(1, warc.record(1, "u", b"abc" * 100, None))
    data = bytearray(bundle.close())
    table = warc.seek_table(bytes(data))
    assert warc.parse(warc.frame(bytes(data), table[0]))[2] == b"abc" * 100
    with pytest.raises(ValueError):
        warc.seek_table(bytes(data[:-1]))
    with pytest.raises(ValueError):
        warc.frame(bytes(data), (*table[0][:3], table[0][3] ^ 1))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None).replace(b"abc", b"abd"))
