"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames, so any frame can be read alone. A bundle
ends with a seek table (a skippable frame that every Zstandard reader passes over) and
comes with the place of each record: frame number, offset and length in that frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ruleloom.session import cut_lineage

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 22
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the two formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

BUNDLE_SCHEMA = "bundle string, data binary, records array<struct<page_id:long,frame:int,start:long,length:long>>"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, start long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value without line ends and other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, target: int | None, date: str = DATE) -> bytes:
    """One record: a response, or a revisit of page `target` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if target is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if target is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(target)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:])


def parse(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """The fields of a record, the size of its payload, and the payload of a response.

    Raises ValueError where the record's length or its payload's digest does not hold.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if not head.startswith(b"WARC/1.") or end != b"\r\n\r\n":
        raise ValueError("not one whole record")
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["Content-Length"])
    if fields["WARC-Type"] != "response":
        return fields, size, None
    if len(body) != size or fields["WARC-Payload-Digest"] != f"sha1:{digest_of(body)}":
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} fails its digest")
    return fields, size, body


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len(URN) + 1 : -1]
    return int(number) if number else None


class Bundle:
    """Collects records into frames, and frames into one seekable file."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.places: list[tuple] = []
        self.open: list[bytes] = []
        self.open_bytes = self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.places.append((page_id, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self.open:
            return
        plain = b"".join(self.open)
        packed = self.packer.compress(plain)
        self.frames.append(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.size += len(packed)
        self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        """The file: the frames, then the seek table."""
        self._close_frame()
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(place, packed size, plain size, checksum) of every frame, from the file's end."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
        raise ValueError("no seek table with checksums at the end")
    at = len(data) - 9 - 12 * count
    if struct.unpack_from("<II", data, at - 8) != (SKIPPABLE_MAGIC, 12 * count + 9):
        raise ValueError("the seek table is not framed")
    out, place = [], 0
    for packed, plain, check in struct.iter_unpack("<III", data[at:-9]):
        out.append((place, packed, plain, check))
        place += packed
    return out


def frame(data: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """The plain bytes of one frame, tested against the seek table."""
    place, packed, size, check = entry
    plain = zstandard.ZstdDecompressor().decompress(data[place : place + packed], max_output_size=size)
    if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
        raise ValueError("a frame fails its checksum")
    return plain


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema, frame_bytes: int, bundle_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0

    def closed(bundle: Bundle) -> pa.RecordBatch:
        data = bundle.close()
        places = [dict(zip(("page_id", "frame", "start", "length"), p)) for p in bundle.places]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([f"{part:06d}-{made:06d}"], [data], [places]), schema)], schema=schema)

    bundle = Bundle(frame_bytes, level)
    for batch in batches:
        columns = [batch.column(n) for n in ("page_id", "url", "payload", "target")]
        for i in range(batch.num_rows):
            page_id, url, payload, target = (c[i].as_py() for c in columns)
            bundle.add(page_id, record(page_id, url, payload, target, date))
            if bundle.size >= bundle_bytes:
                yield closed(bundle)
                bundle, made = Bundle(frame_bytes, level), made + 1
    if bundle.places:
        yield closed(bundle)


def _unpack(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, files, places = (batch.column(n) for n in ("bundle", "data", "records"))
        for i in range(batch.num_rows):
            name, data, rows = names[i].as_py(), files[i].as_py(), []
            table, held, plain = seek_table(data), -1, b""
            for place in places[i].as_py():
                if place["frame"] != held:
                    held = place["frame"]
                    plain = frame(data, table[held])
                fields, size, _ = parse(plain[place["start"] : place["start"] + place["length"]])
                if _page(fields["WARC-Record-ID"]) != place["page_id"]:
                    raise ValueError(f"bundle {name} has another record where {place} should be")
                rows.append((place["page_id"], size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), name, place["frame"], place["start"], place["length"]))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """(bundle, data, records): the bundles as rows, written to the shared folder.

    Among rows of equal payload of at least `min_payload` bytes the one with the largest
    id is a response and the others are revisits of it; shorter payloads are always
    responses. A null text is an empty payload, a null address leaves its field out, a
    null id never is the one referred to (rows without any id in their group are all
    responses), and repeats of the largest id are all responses. Other columns are not
    read; an empty table gives no bundle.

    Equal payloads meet as one row a digest, counted before the shuffle. The join that
    hands the outcome back carries every page to its digest; a digest that a large part
    of the pages share is a skewed join key, which Spark splits, as nothing above the
    join needs the pages of a digest together.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_payload
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    last = F.when(large & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    marked = rows.join(groups, "digest", "left").select("page_id", "url", "payload", last.alias("target"))
    schema = to_arrow_schema(T.StructType.fromDDL(BUNDLE_SCHEMA))
    return cut_lineage(marked.mapInArrow(partial(_pack, schema=schema, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, level=level, date=date), BUNDLE_SCHEMA))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record by its place: payload size and digest, type, referred page and place.

    Seek table, frame checksums, record lengths and payload digests are tested; a
    damaged bundle raises an error.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(RECORD_SCHEMA))
    return bundles.select("bundle", "data", "records").mapInArrow(partial(_unpack, schema=schema), RECORD_SCHEMA)


def places(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle, frame, start, length): where each record is."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.start", "r.length")
