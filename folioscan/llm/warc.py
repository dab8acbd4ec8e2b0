"""WARC archives with revisit records for repeated payloads.

Headers are grouped by payload digest, the smallest page of a digest answers for
it, and every other page of that digest becomes a revisit record that names it.
Archives are gzip files with one member per record.

Defined results: a null html is an empty payload; payloads below ``min_bytes``
are always responses; rows that repeat the page id of the answering page are
responses too; a row without page id revisits the answering page if there is one
and is a response otherwise; an empty table gives no archive; a null url becomes
a URN of the page; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscan.llm import common

SALTS = 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string"


def resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Pages with payload, digest and ``original``: the page that answers for the digest.

    Only (digest, page id) is shuffled to find originals; page ids are reduced
    before that shuffle.  The join with the originals shuffles the payloads once;
    a digest of very many pages is joined in ``SALTS`` parts.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    )
    base = base.withColumn("digest", F.sha2("payload", 256))
    originals = (
        base.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("original").isNotNull())
        .select("digest", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(originals.hint("shuffle_hash"), ["digest", "salt"], "left").select(
        "page_id", "url", "payload", "digest", "original"
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, str]], http: bytes, payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    head += f"Content-Length: {len(http) + len(payload)}\r\n\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(head.encode("utf-8") + http + payload + b"\r\n\r\n") + gz.flush()


def page_record(page_id, url, payload: bytes, digest: str, original, date: str) -> bytes:
    page = "" if page_id is None else str(page_id)
    target = urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page}"
    revisit = original is not None and original != page_id
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", _record_id(original, digest)),
            ("X-Refers-To-Page-Id", str(original)),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _record(headers, http.encode("ascii"), b"" if revisit else payload)


def write_archives(resolved: DataFrame, archive_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives and list them: (archive, path, n_records).

    Tasks roll to a new file at ``archive_bytes``.  Names are new for every
    attempt; only files of finished tasks are listed.
    """
    spark = resolved.sparkSession
    common.bounded_batches(spark)
    folder = common.shared_folder(spark, "warc")
    store, path = common.open_store(folder)
    store.create_dir(path, recursive=True)
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("n_records", pa.int64())])

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, files, out, size = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, 0
        for batch in rows:
            for page_id, url, payload, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{task:06d}-{len(files):05d}"
                    files.append([name, f"{folder}/{name}-{attempt}.warc.gz", 0])
                    store, path = common.open_store(files[-1][1])
                    out = store.open_output_stream(path, compression=None)
                    info = f"software: folioscan\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                    head = [
                        ("WARC-Type", "warcinfo"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                        ("WARC-Date", date),
                        ("Content-Type", "application/warc-fields"),
                    ]
                    out.write(_record(head, b"", info))
                    size = 0
                record = page_record(page_id, url, payload, digest, original, date)
                out.write(record)
                size += len(record)
                files[-1][2] += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], schema=schema)

    return common.stored(resolved.mapInArrow(write, "archive string, path string, n_records long"), "warc-list")


def records(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of one archive."""
    store, path = common.open_store(uri)
    with store.open_input_stream(path, compression=None) as f:
        rest = b""
        while True:
            rest = rest or f.read(chunk)
            if not rest:
                return
            member, parts = zlib.decompressobj(31), []
            while not member.eof:
                rest = rest or f.read(chunk)
                if not rest:
                    raise ValueError(f"{uri} ends within a record")
                parts.append(member.decompress(rest))
                rest = member.unused_data
            raw = b"".join(parts)
            at = raw.index(b"\r\n\r\n")
            lines = raw[:at].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{uri} holds no WARC record where one should start")
            headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
            yield headers, raw[at + 4 : at + 4 + int(headers["content-length"])]


def read_archives(files: DataFrame) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the payload that is read and must
    equal the one in its header.
    """
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for uri in batch.column(0).to_pylist():
                out: list[tuple] = []
                for head, block in records(uri):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    at = block.index(b"\r\n\r\n") + 4
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    size = int(re.search(rb"Content-Length: (\d+)", block[:at])[1])
                    if head["warc-type"] == "response":
                        payload = block[at:]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload and header differ in {uri}, {head['warc-record-id']}")
                    page, to = head["x-page-id"], head.get("x-refers-to-page-id")
                    out.append((int(page) if page else None, size, digest, head["warc-type"], int(to) if to else None))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return (
        common.one_task_each(files.select("archive", "path"), "archive")
        .select("path")
        .mapInArrow(
            read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    )


def archive_pages(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write deduplicated archives of ``pages(page_id, url, html)`` and read them back."""
    return read_archives(write_archives(resolve(pages, min_bytes)))
