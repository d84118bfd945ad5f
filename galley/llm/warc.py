"""Operator 8. Zstandard WARC archives: one frame per record, dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common

#: The skippable frame that holds the dictionary, and the magic numbers of Zstandard frames and dictionaries.
DICT_FRAME, FRAME, DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: A file ends after the record that brings it to this size. The dictionary is trained on pages up to these bounds.
FILE_BYTES, SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 16 << 20, 400, 16_384, 65_536
DATE = "2024-01-01T00:00:00Z"
RECORDS = "file string, record long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame) -> bytes:
    """From the starts of at most SAMPLE_PAGES pages, those of least hash of the id; empty if they are too few."""
    rows = pages.where("html is not null and page_id is not null").orderBy(F.xxhash64("page_id"), "page_id")
    rows = rows.select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_PAGES).toArrow()["html"].to_pylist()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r.encode() for r in rows if r]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit of the page `response` with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    block = http + (payload if response is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if response is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(response)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record. Every length and digest it states is held against the bytes."""

    def headers(text: bytes, first: bytes) -> dict[str, str]:
        line, *rest = text.split(b"\r\n")
        if not line.startswith(first):
            raise WarcError(f"a record begins with {line[:20]!r}")
        out = {}
        for x in rest:
            key, colon, value = x.partition(b":")
            if not colon:
                raise WarcError(f"no header: {x[:40]!r}")
            out[key.decode().lower()] = value.strip().decode()
        return out

    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("a record without an end of headers")
    fields = headers(head, b"WARC/1.")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing or not fields["content-length"].isdigit():
        raise WarcError(f"headers missing or wrong: {sorted(missing) or 'content-length'}")
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise WarcError(f"a block of {len(rest) - 4} bytes, {size} stated")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("the block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    inner = headers(http, b"HTTP/")
    if not found or not inner.get("content-length", "").isdigit():
        raise WarcError("no HTTP headers")
    kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(inner["content-length"]) or digest(payload) != stated):
        raise WarcError("the payload's length or digest differs")
    if kind not in ("response", "revisit") or (kind == "revisit" and (payload or "warc-refers-to" not in fields)):
        raise WarcError(f"a bad {kind} record")
    page = lambda x: None if (n := x.removeprefix("<urn:page:").removesuffix(">")) == "none" else int(n)
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(inner["content-length"]),
        "payload_digest": stated, "record_type": kind, "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded frames of an archive. The dictionary, raw or itself compressed, is in a skippable frame at the start."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        held = bytes(view[8 : 8 + size])
        if len(held) != size:
            raise WarcError("the dictionary is cut off")
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        if held[:4] != struct.pack("<I", DICT):
            raise WarcError("the leading frame holds no dictionary")
        dictionary, at = zstandard.ZstdCompressionDict(held), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= (magic := struct.unpack_from("<I", data, at)[0]) <= 0x184D2A5F:
            if magic == DICT_FRAME:
                raise WarcError("a second dictionary")
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one = reader.decompressobj()
        try:
            out = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"no frame at byte {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut off")
        at = len(data) - len(one.unused_data)
        yield out


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with response: the smallest page_id of an equal payload of at least `least` bytes where that is another page.

    Equal means the same SHA-1 and length. Null html is empty. Page ids may repeat: a row whose id is the smallest is
    a response. Rows without an id are responses. Only digests are grouped and matched; a page then meets the row of its
    own id, so that no payload many pages share is a key. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    first = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    first = common.materialize(first.where("c > 1").drop("c"), "first")
    others = rows.drop("url", "html").join(common.large(first), ["sha", "size"]).where(F.col("first") != F.col("page_id"))
    others = common.materialize(others.select("page_id", "sha", "size", "first").distinct(), "revisits")
    joined = rows.join(others, ["page_id", "sha", "size"], "left")
    return joined.select("page_id", "url", "html", F.col("first").alias("response"))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes = b"", level: int = 6) -> DataFrame:
    """Write (page_id, url, html, response) as .warc.zst files in a shared folder; (file, records, bytes) per file.

    Each task writes its own files, through Arrow's file systems, under a name that no other attempt has; only files
    that a finished task reports belong to the archive, so lost and repeated tasks do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True, write_content_size=True)
        start = b""
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            start = struct.pack("<II", DICT_FRAME, len(packed)) + packed
        parts, size, n, count, done = [start], len(start), 0, 0, []
        attempt = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"

        def close() -> None:
            nonlocal parts, size, n, count
            if n:
                name = f"part-{attempt}-{count:04d}.warc.zst"
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(b"".join(parts))
                done.append((f"{folder}/{name}", n, size))
                count += 1
            parts, size, n = [start], len(start), 0

        for batch in batches:
            for row in common.dicts(batch, 100):
                frame = writer.compress(record(row["page_id"], row["url"], row["html"].encode(), row["response"]))
                parts.append(frame)
                size, n = size + len(frame), n + 1
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "records": r, "bytes": b} for f, r, b in done], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        )

    return common.materialize(rows.mapInArrow(run, "file string, records long, bytes long"), "files")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in column file: RECORDS, payload null for revisits. A broken archive raises WarcError.

    Files are dealt to tasks one by one and opened through Arrow's file systems; a task holds one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = pafs.FileSystem.from_uri(file)
                with system.open_input_stream(path, compression=None) as f:
                    data = f.read()
                held, size = [], 0
                for i, raw in enumerate(frames(data)):
                    row = parse(raw) | {"file": file, "record": i}
                    size += len(raw)
                    held.append(row if payloads else row | {"payload": None})
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema).select(names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema).select(names)

    # A given number of partitions: Spark would join these few bytes into one task, which would read all archives.
    return files.select("file").repartition(min(max(1, files.count()), 10_000), "file").mapInArrow(run, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(typed(pages), folder, train_dictionary(pages))
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: SHA-1 bytes are spelt five bits at a time.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: list_extract(
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
  strpos('0123456789abcdef', substr(hex, (i + 1)::INT, 1))::BIGINT)), '') AS bits FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT
     + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
