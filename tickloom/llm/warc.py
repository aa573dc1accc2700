"""WARC archives from page rows, records from archives, and captures from records.

Archives are written by Spark's text writer, a record per line with the two line ends that close a
record as separator, so they land wherever Spark can write. They are read whole file by whole file
and cut by Content-Length, never by what a payload may contain.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are written again rather than referred to.
LEAST = 1000
#: Records per archive; with the size of an input split it bounds what one task holds.
PER_FILE = 30_000
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADERS = pa.map_(pa.string(), pa.string())
RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("http_status", pa.int32()),
        ("headers", _HEADERS),
        ("payload", pa.binary()),
    ]
)
RECORD_SCHEMA = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, "
    "refers_to string, payload_digest string, payload_bytes long, http_status int, "
    "headers map<string,string>, payload binary"
)


def _urn(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind} {key}'.encode()).digest(), version=4)}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _line(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def page_records(page_id, url: str | None, html: bytes, keep_id, sha: bytes) -> list[bytes]:
    """Request, response (or revisit of page `keep_id`) and metadata of one page; `sha` of its payload."""
    digest = "sha1:" + base64.b32encode(sha).decode()
    name = sha.hex()

    def key(page) -> str:
        return f"{page} {name}"

    uri = [("WARC-Target-URI", _line(url))] if url else []
    response_id, request_id = _urn("response", key(page_id)), _urn("request", key(page_id))
    revisit = keep_id is not None and keep_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n"
    common = [("WARC-Date", DATE), *uri]
    about = [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields = [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", response_id), *common, *about,
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("response", key(keep_id))),
        ]
    else:
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", response_id), *common, *about]
    return [
        _record(
            [
                ("WARC-Type", "request"), ("WARC-Record-ID", request_id), *common,
                ("WARC-Concurrent-To", response_id),
                ("Content-Type", "application/http; msgtype=request"),
            ],
            f"GET {_line(url) if url else '/'} HTTP/1.1\r\n\r\n".encode(),
        ),
        _record(fields, http.encode() + (b"" if revisit else html)),
        _record(
            [
                ("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", key(page_id))), *common,
                ("WARC-Concurrent-To", response_id), ("Content-Type", "application/warc-fields"),
            ],
            b"" if page_id is None else f"page-id: {page_id}\r\n".encode(),
        ),
    ]


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST,
) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of `pages`.

    Of rows with equal payloads of at least `least` bytes, that with the largest id is the response
    (each row that repeats this id is), the others revisit it; so do rows without an id, unless no
    row of the group has one: then all are responses. A null payload is empty, a null address is
    left out. Rows that repeat id and payload are written each, under the same record ids.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("html"),
    ).withColumn("sha", F.unhex(F.sha1("html")))
    # Small payloads meet no group: a key of their own keeps equal ones apart.
    own = F.unhex(F.md5(F.concat_ws(" ", "page_id", "url").cast("binary")))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least, F.col("sha")).otherwise(own))
    groups = (
        rows.filter(F.octet_length("html") >= least)
        .groupBy("key")
        .agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
        .drop("times")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                records = page_records(*row)
                out += records
                held += sum(map(len, records))
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    (
        rows.join(groups, "key", "left")
        .select("page_id", "url", "html", "keep_id", "sha")
        .mapInArrow(build, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", PER_FILE)
        .text(path)
    )


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain or gzipped file (one member or many), piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(content):
        piece = content[at : at + step]
        at += len(piece)
        while piece:
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof and piece:
                member = zlib.decompressobj(31)
    yield member.flush()


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            if name.strip():
                out.append((name.strip().lower(), value.strip()))
    return out


def cut_records(content: bytes, path: str) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of each record of a file. ValueError where it is no archive."""
    buffer, source = bytearray(), _inflated(content)

    def more() -> bool:
        for piece in source:
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        while (stop := buffer.find(b"\r\n\r\n")) < 0 or stop == 0:
            if stop == 0:
                del buffer[:2]
            elif not more():
                if buffer.strip():
                    raise ValueError(f"{path}: the archive ends within a record's header")
                return
        first, *lines = buffer[:stop].decode("utf-8", "replace").lstrip().split("\r\n")
        fields = _fields(lines)
        length = dict(fields).get("content-length", "")
        if not first.startswith("WARC/") or not length.isdigit():
            raise ValueError(f"{path}: no record where one should begin: {first[:60]!r}")
        while len(buffer) < stop + 4 + int(length):
            if not more():
                raise ValueError(f"{path}: the archive ends within a record")
        yield fields, bytes(buffer[stop + 4 : stop + 4 + int(length)])
        del buffer[: stop + 4 + int(length)]


def _row(fields: list[tuple[str, str]], block: bytes, payloads: bool) -> tuple:
    """The values of RECORD's columns."""
    named = dict(fields)
    kind = named.get("warc-type")
    payload, size, status = block, len(block), None
    if named.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, *rest = head.decode("utf-8", "replace").split("\r\n")
        http, words = dict(_fields(rest)), first.split()
        if first.startswith("HTTP/") and len(words) > 1 and words[1].isdigit():
            status = int(words[1])
        size = len(payload)
        if kind == "revisit" and http.get("content-length", "").isdigit():
            size = int(http["content-length"])
    digest = named.get("warc-payload-digest", "")
    if kind == "response":
        sha = hashlib.sha1(payload)
        if digest.startswith("sha1:") and digest[5:] != base64.b32encode(sha.digest()).decode():
            raise ValueError(f"{named.get('warc-record-id')}: the payload is not the one digested")
        digest = sha.hexdigest()
    elif digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    return (
        named.get("warc-record-id"),
        kind,
        named.get("warc-target-uri"),
        named.get("warc-date"),
        [v for k, v in fields if k == "warc-concurrent-to"],
        named.get("warc-refers-to"),
        digest or None,
        size,
        status,
        list(named.items()),
        payload if payloads or kind == "metadata" else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, f.type) for column, f in zip(zip(*rows), RECORD)], schema=RECORD
    )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under `path`, gzipped or plain, digests as hex SHA-1.

    Without `payloads` only metadata records keep theirs; digests are checked all the same, and a
    payload that isn't the one digested, like a broken archive, is an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out, held = [], 0
                for fields, block in cut_records(content.as_py(), name.as_py()):
                    out.append(_row(fields, block, payloads))
                    held += len(block) + 1000
                    if held > 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("path", "content").mapInArrow(parse, RECORD_SCHEMA)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the structs response, request and metadata.

    A request or metadata record belongs to the response or revisit that it names as concurrent,
    or that names it. Of several, the one with the smallest record id is nested and n_requests and
    n_metadata count them. Records that name a response that isn't there still give a capture, with
    a null response; those that name nothing and are named by nothing are no part of a capture.
    """
    parts = F.struct(
        "record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes",
        "http_status", "headers", "payload",
    )
    answer = F.col("type").isin("response", "revisit")
    answers = records.filter(answer)
    named = answers.select(
        F.explode("concurrent_to").alias("member"), F.col("record_id").alias("capture_id")
    )

    def belonging(kind: str, count: str) -> DataFrame:
        found = records.filter(F.col("type") == kind).withColumn("part", parts)
        own = found.select(F.explode("concurrent_to").alias("capture_id"), "record_id", "part")
        other = found.join(named, found["record_id"] == named["member"]).select(
            "capture_id", "record_id", "part"
        )
        return (
            own.unionByName(other)
            .groupBy("capture_id")
            .agg(
                F.min_by("part", "record_id").alias(kind),
                F.countDistinct("record_id").alias(count),
            )
        )

    response = answers.select(F.col("record_id").alias("capture_id"), parts.alias("response"))
    return response.join(belonging("request", "n_requests"), "capture_id", "full").join(
        belonging("metadata", "n_metadata"), "capture_id", "full"
    )
