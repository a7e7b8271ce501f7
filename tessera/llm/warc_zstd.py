"""WARC archives compressed by Zstandard: one frame for each record, with a dictionary in a leading skippable
frame; writing, and reading back with validation.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw or compressed, then
one frame per record. Between the frames the writer leaves empty skippable frames, which decoders pass over:
they are the line separator that lets Spark's own text sink write the archives, with its task commits, to any
file system. Payloads repeated in the collection are written once; later ones are revisit records.

A dictionary is trained in each archive on its first records, at most `sample_bytes` of them (a bound, not a
share of the data; it changes sizes only, never contents). Too small a sample makes it a raw-content
dictionary; an archive without payloads has an empty dictionary frame.

Defined cases: a null page text is an empty payload; an empty or short payload (under `min_revisit` bytes) is
never a revisit; rows that repeat the smallest page_id are all responses; a null page_id is never referred to
while another has the same payload; a null or unprintable URL becomes `urn:page:<id>` or percent-encoded; an
empty table makes an empty folder of archives, which reads as no records. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import shared_path, shared_table

DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame, all of whose bytes are ASCII: magic 0x184D2A50, length 0.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper bound of a decoded record, so that a damaged length can't ask for any memory.
MAX_RECORD = 1 << 31

RECORDS = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


# ---------------------------------------------------------------- records
def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which holds the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or f"urn:page:{page_id}")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", str(len(block)))]
    head += [("Page-ID", str(page_id))] * (page_id is not None)
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header line: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> tuple:
    """The row of RECORDS for one decoded record; ValueError if a header, length or digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of the header")
    h = _headers(lines[1:])
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in h:
            raise ValueError(f"mandatory header {k} is missing")
    n = int(h["content-length"])
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content-length {n} does not fit a block of {len(rest) - 4} bytes")
    kind, page, digest = h["warc-type"], h.get("page-id"), h.get("warc-payload-digest", "").removeprefix("sha256:")
    page = None if page is None else int(page)
    if kind not in ("response", "revisit"):
        return h["warc-record-id"], kind, h.get("warc-target-uri"), page, None, n, digest or None, rest[:n]
    status, end, payload = rest[:n].partition(b"\r\n\r\n")
    http = status.split(b"\r\n")
    if not end or not http[0].startswith(b"HTTP/"):
        raise ValueError("no HTTP header in the block")
    size = int(_headers(http[1:])["content-length"])
    if kind == "revisit":
        if payload or h.get("warc-profile") != PROFILE or "warc-refers-to" not in h:
            raise ValueError("a revisit record needs its profile and the record it refers to, and no payload")
        refers = h.get("refers-to-page-id")
        return h["warc-record-id"], kind, h.get("warc-target-uri"), page, None if refers is None else int(refers), size, digest, None
    if size != len(payload):
        raise ValueError(f"HTTP content-length {size} against {len(payload)} bytes")
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("the payload's digest is wrong")
    return h["warc-record-id"], kind, h.get("warc-target-uri"), page, None, size, digest, payload


# ---------------------------------------------------------------- archives
def _dictionary(samples: list[bytes], size: int) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    data = b""
    if len(samples) >= 16:
        try:
            data = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # the samples are too small or too alike
            data = b""
    data = data or b"".join(samples)[:size]
    return data, zstandard.ZstdCompressionDict(data) if data else None


def archive_frames(records: Iterator[bytes], level: int = 3, sample_bytes: int = 1 << 20, dict_bytes: int = 1 << 14) -> Iterator[bytes]:
    """The dictionary's skippable frame, then a frame for each record."""
    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= sample_bytes:
            break
    if not first:
        return
    data, dictionary = _dictionary([r[:1 << 16] for r in first], dict_bytes)
    # the dictionary itself is stored compressed, as the convention allows
    stored = zstandard.ZstdCompressor(level=level).compress(data) if data else b""
    yield struct.pack("<II", DICT_MAGIC, len(stored)) + stored
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for r in first:
        yield packer.compress(r)
    first.clear()
    for r in records:
        yield packer.compress(r)


def read_archive(blob: bytes) -> Iterator[bytes]:
    """The decoded records of an archive; ValueError if its frames are damaged or a frame is not one record."""
    at, view, dictionary = 0, memoryview(blob), None
    if len(blob) >= 8 and struct.unpack_from("<I", blob)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", blob, 4)[0]
        stored = bytes(view[8:8 + n])
        if len(stored) != n:
            raise ValueError("the dictionary frame is cut off")
        if stored[:4] == struct.pack("<I", FRAME_MAGIC):
            stored = zstandard.ZstdDecompressor().decompress(stored, max_output_size=1 << 27)
        dictionary, at = zstandard.ZstdCompressionDict(stored) if stored else None, 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(blob):
        if len(blob) - at < 8:
            raise ValueError("bytes are left after the last frame")
        magic, n = struct.unpack_from("<II", blob, at)
        if magic in SKIPPABLE:
            at += 8 + n
            if at > len(blob):
                raise ValueError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins at byte {at}")
        one = reader.decompressobj()
        size = zstandard.frame_content_size(view[at:at + 18])
        if size > MAX_RECORD:
            raise ValueError(f"a record of {size} bytes")
        parts, end = [], at
        while not one.eof:
            if end >= len(blob):
                raise ValueError("the last frame is cut off")
            step = bytes(view[end:end + (1 << 20)])
            parts.append(one.decompress(step))
            end += len(step)
        at = end - len(one.unused_data)
        yield b"".join(parts)


# ---------------------------------------------------------------- Spark
def revisit_plan(pages: DataFrame, min_revisit: int, id_col: str, text: Column) -> DataFrame:
    """`pages` with digest and the page_id of the first of its payload's copies. Copies are found on digests
    alone, summed up before they are exchanged; the table of repeated payloads is then joined by its digest."""
    keyed = pages.withColumn("digest", F.sha2(text.cast("binary"), 256))
    again = keyed.filter(F.octet_length(text) >= min_revisit).groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
    again = shared_table(again.filter("n > 1").select("digest", "first_id"), "warc-repeated")
    return keyed.join(again, "digest", "left")


def write_archives(pages: DataFrame, path: str, min_revisit: int = 100, archive_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Write `pages` as WARC archives of about `archive_bytes` of payload each under `path`."""
    spark = pages.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("html"))
    total = rows.agg(F.sum(F.octet_length("html").cast("long") + 600)).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    planned = revisit_plan(rows, min_revisit, "page_id", F.col("html")).select("page_id", "url", F.col("html").cast("binary").alias("payload"), "digest", "first_id")
    # dealt by page, not by payload: copies of one page spread over all archives
    planned = planned.repartition(parts, F.xxhash64("page_id", "url"))

    def pack(batches):
        def records():
            for b in batches:
                for p, u, x, d, f in zip(*(b.column(i).to_pylist() for i in range(5))):
                    yield build_record(p, u, x, d, f, f is not None and f != p)
        held, size = [], 0
        for frame in archive_frames(records()):
            held.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    frames = planned.mapInArrow(pack, "value binary")
    # the sink writes the bytes as they are; its line separator is an empty skippable frame
    frames.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path` (columns RECORDS), each checked for frame, headers, lengths
    and digest; the first fault ends the query, naming the archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, blob = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                held, size = [], 0
                try:
                    for raw in read_archive(blob):
                        row = parse_record(raw)
                        held.append(row if payloads else (*row[:-1], None))
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{name}: record {len(held)} of its batch: {e}") from e
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return files.mapInArrow(unpack, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives of `pages` written to the shared folder and read back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
