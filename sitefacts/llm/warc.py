"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame.

``write_archives`` writes records below a shared path and gives a manifest; ``read_archives`` decodes
the archives of a manifest. Files of failed or repeated task attempts stand in no manifest and are
never read.

Rules for odd input: a null html is an empty payload; null urls are written as an empty target;
line breaks in urls are percent-encoded. Equal payloads of ``min_bytes`` or more become revisits of the
smallest page_id that has them; repeated rows of that page are responses too, and so are rows without
a page_id, which nothing can refer to. An empty table gives an empty manifest. Only page_id, url and
html are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.functions.joins import lookup_join
from sitefacts.llm.common import columns, land, utf8

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class ArchiveError(ValueError):
    """A frame, header or length that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: dict, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = page["refers_to"] is not None
    block = http if revisit else http + payload
    own = f"{RECORD_URN}{page['page_id']}" if page["page_id"] is not None else f"urn:uuid:{uuid.uuid4()}"
    target = (page["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_URN}{page['refers_to']}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the archive's first records, or their raw bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


class ArchiveWriter:
    """Writes one archive; holds at most SAMPLE_BYTES of records until the dictionary is made."""

    def __init__(self, root: str):
        self.path, self.waiting, self.size, self.n, self.stream, self.packer, self.raw = f"{root}/{uuid.uuid4().hex}.warc.zst", [], 0, 0, None, None, 0

    def add(self, record: bytes) -> None:
        self.raw += len(record)
        self.n += 1
        if self.stream is not None:
            self.put(self.packer.compress(record))
            return
        self.waiting.append(record)
        if self.raw >= SAMPLE_BYTES:
            self.open()

    def open(self) -> None:
        data = trained_dictionary([r[: SAMPLE_BYTES // 16] for r in self.waiting])
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True, write_checksum=True)
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(at, compression=None)
        packed = zstandard.ZstdCompressor(level=19).compress(data)
        self.put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        for record in self.waiting:
            self.put(self.packer.compress(record))
        self.waiting = []

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> dict:
        if self.stream is None:
            self.open()
        self.stream.close()
        return {"path": self.path, "n_records": self.n, "n_bytes": self.size}


def with_first_pages(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page of an equal payload, null for responses.

    Pages are counted per digest in the map tasks first; only digests of two pages or more meet the rows
    again, and since they are landed Spark can split a digest that many rows share.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    joined = lookup_join(rows, shared, ["digest"])
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes a record per page below ``root`` and gives the landed manifest (path, n_records, n_bytes)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*columns(batch, "page_id", "url", "html", "refers_to")):
                writer = writer or ArchiveWriter(root)
                writer.add(record_bytes({"page_id": page_id, "url": url, "refers_to": refers_to}, utf8(html), date))
                if writer.raw >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return land(with_first_pages(pages, min_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each frame after the leading dictionary frame."""
    head = stream.read(8)
    if len(head) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack("<II", head)
    data = stream.read(size)
    if magic != DICTIONARY_MAGIC or len(data) != size:
        raise ArchiveError("no whole dictionary in the leading skippable frame")
    if data[:4] == FRAME_MAGIC:
        data = zstandard.ZstdDecompressor().decompress(data)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    offset, rest = 8 + size, stream.read(1 << 20)
    while rest:
        one, parts, start = unpacker.decompressobj(), [], offset
        while not one.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ArchiveError(f"the frame at {start} is cut off")
            try:
                parts.append(one.decompress(rest))
            except zstandard.ZstdError as error:
                raise ArchiveError(f"the frame at {start}: {error}") from error
            offset += len(rest) - len(one.unused_data)
            rest = one.unused_data
        yield start, b"".join(parts)
        rest = rest or stream.read(1 << 20)


def parsed_record(data: bytes) -> dict:
    """Headers, payload and digest of a record, with its lengths and digests checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"header {line!r}")
        headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ArchiveError(f"without {sorted(missing)}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length differs from the block")
    block = rest[:-4]
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [line.partition(b":")[2].strip() for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if not gap or len(lengths) != 1 or not lengths[0].isdigit():
        raise ArchiveError("no HTTP head of one length")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-block-digest", "").removeprefix("sha1:") not in ("", sha1_base32(block)):
        raise ArchiveError("the block differs from its digest")
    if kind == "response" and (len(payload) != int(lengths[0]) or digest != sha1_base32(payload)):
        raise ArchiveError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ArchiveError("a revisit with a payload or without its record")
    return {
        "record_type": kind, "record_id": headers["warc-record-id"].strip("<>"), "target_uri": headers.get("warc-target-uri"), "refers_to": headers["warc-refers-to"].strip("<>") if kind == "revisit" else None,
        "payload_bytes": int(lengths[0]), "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def read_archives(manifest: DataFrame, with_payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """One row per record of the manifest's archives; raises ArchiveError on a broken record or a lost one.

    ``with_payload=False`` decodes and checks payloads but does not return them.
    """
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, n_records in zip(*columns(batch, "path", "n_records")):
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    found = 0
                    for offset, data in frames(stream):
                        row = parsed_record(data) | {"path": path, "offset": offset}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        found, held = found + 1, held + 200 + len(row["payload"] or b"")
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if found != n_records:
                    raise ArchiveError(f"{path}: {found} records of {n_records}")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # one archive per task, whatever the manifest's own split
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "path").mapInArrow(read, RECORD)
