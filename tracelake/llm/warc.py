"""WARC files: a distributed writer, and a reader that splits gzip files at record bounds without an index.

Writer. Payload digests are grouped (thin rows, combined before the shuffle) to find, among equal payloads, the smallest id,
whose record is the response; the others become revisit records that refer to it. Each task writes its own file, one gzip
member per record, under a name of its partition, first to a name of the attempt and then moved, so a repeated task leaves
one whole file.

Reader. Files are cut into byte ranges; a task scans its range for the gzip magic, accepts a candidate only if the member
there decodes to a WARC version line and a header, of any size, with a length, and owns the records that start inside its range. From an
accepted record it goes on member by member, past the end of its range if the last record does. A damaged member is skipped
by scanning on from its start.

Files are reached through Arrow's file systems, so the folder may be any that they and Spark share. Null payloads are empty;
null urls leave the target header out; repeated rows give one record each, and where they share the smallest id of a payload
all of them are responses. A null id can be written, is a response only where all ids of its payload are null, and comes back
as null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import new_folder, stored

#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

SPLIT_BYTES = 32 << 20
READ_BYTES = 256 << 10


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _urn(number: int | None) -> str:
    """The id as a UUID: its low 64 bits; a higher bit stands for null."""
    x = f"{(1 << 64) if number is None else number & ((1 << 64) - 1):032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(number), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _urn(refers_to)}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + out.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}.warc.gz"
    store, path = _opened(folder)
    attempt, n = f"{path}/.{name}-{task.taskAttemptId()}", 0
    with store.open_output_stream(attempt, compression=None) as out:
        for batch in batches:
            for number, url, html, revisit, refers_to in zip(*batch.columns):
                payload = (html.as_py() or "").encode()
                out.write(_record(number.as_py(), url.as_py(), payload, base32_sha1(payload), refers_to.as_py(), revisit.as_py()))
                n += 1
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        store.move(attempt, f"{path}/{name}")
    else:  # an earlier attempt of this task has moved its whole file and was lost after that
        store.delete_file(attempt)
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "n_records"])


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write one record per row into ``folder`` and return the stored table (file, n_records).

    Payloads of ``min_bytes`` or more that are equal become one response and revisits; smaller ones are all responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    large = F.octet_length("html") >= min_bytes
    first = rows.filter(large).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    #: stored, so that its size is known before the join is planned
    first = stored(first.select("digest", "first_id", F.lit(True).alias("shared")), "warc-first")
    rows = rows.join(first, "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & large & ~F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.select("id", "url", "html", revisit.alias("revisit"), "first_id")
    store, path = _opened(folder)
    store.create_dir(path, recursive=True)
    return stored(rows.mapInArrow(partial(_write, folder=folder), "file string, n_records long"), "warc-manifest")


class _Bytes:
    """A file as a sliding stretch of bytes."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        x = self.file.read(READ_BYTES)
        self.data += x
        return bool(x)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _head(text: bytes | bytearray) -> dict[str, str] | None:
    """The header fields, names in lower case, if ``text`` starts a record and holds its header."""
    if not text.startswith(b"WARC/1."):
        return None
    end = text.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(x.partition(":")[::2] for x in text[:end].decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _member(source: _Bytes) -> tuple[bytes, int] | None:
    """The decoded member at the start of ``source`` and its length in the file, or None if no record starts there."""
    decoder, out, fed, checked = zlib.decompressobj(31), bytearray(), 0, False
    while not decoder.eof:
        if fed == len(source.data) and not source.more():
            return None
        piece = source.data[fed:]
        fed += len(piece)
        try:
            while piece and not decoder.eof:
                x = decoder.decompress(piece, 1 << 20)
                piece = decoder.unconsumed_tail
                got = len(out)
                out += x
                if not checked and len(out) >= 7 and not out.startswith(b"WARC/1."):
                    return None
                # the header ends at the blank line, however long it is
                if not checked and out.find(b"\r\n\r\n", max(0, got - 3)) >= 0:
                    checked = True
                    if _head(out) is None:
                        return None
        except zlib.error:
            return None
    return (bytes(out), fed - len(decoder.unused_data)) if checked else None


def scan_records(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the records that start in [start, end)."""
    source = _Bytes(file, start)
    while source.at < end:
        k = source.data.find(MAGIC)
        if k < 0:
            source.drop(max(0, len(source.data) - 2))
            if not source.more():
                return
            continue
        source.drop(k)
        if source.at >= end:
            return
        found = _member(source)
        if found is None:
            source.drop(1)
            continue
        yield source.at, found[0]
        source.drop(found[1])


RECORD = "file string, offset long, warc_type string, record_id string, refers_to string, target_uri string, digest string, http_length long, payload_bytes long, payload_sha1 string"


def _parsed(whole: bytes) -> tuple:
    fields = _head(whole)
    body = whole[whole.find(b"\r\n\r\n") + 4 :][: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, int(length[1]) if length else None, len(payload), base32_sha1(payload)), payload


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, start, end in zip(*(x.to_pylist() for x in batch.columns)):
            store, name = _opened(path)
            rows, held = [], 0
            with store.open_input_file(name) as file:
                for offset, whole in scan_records(file, start, end):
                    fields, body = _parsed(whole)
                    rows.append((path, offset, *fields, *[body] * payload))
                    held += len(body) * payload + 500
                    if held > 8 << 20:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)


def read_warc(spark: SparkSession, folder: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the ``*.warc.gz`` files in ``folder``; the payload's bytes too, unless ``payload`` is False."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").filter("length > 0")
    step = F.lit(split_bytes).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, "length").alias("end"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(partial(_read, payload=payload), RECORD + ", payload binary" * payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back: (id, payload_bytes, payload_digest, record_type, refers_to).

    A response's length and digest are taken from the payload read; a revisit's from its headers, as it has no payload.
    Raises if fewer or more records are read than were written.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    written = write_warc(pages, folder, id_col, min_bytes=min_bytes).agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    found = read_warc(spark, folder, payload=False)
    own = F.col("warc_type") == "response"
    low = lambda c: _id_of(F.col(c))
    out = found.select(
        low("record_id").alias(id_col),
        F.when(own, F.col("payload_bytes")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(own, F.col("payload_sha1")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~own, low("refers_to")).alias("refers_to"),
    )
    out = stored(out, "warc-read")
    n = out.count()
    if n != written:
        raise RuntimeError(f"{written} records were written to {folder}, {n} were read")
    return out


def _id_of(urn):
    """The number in a record id, by built-in functions: the low 64 bits, signed; null if the bit above is set."""
    digits = F.regexp_replace(F.substring_index(urn, ":", -1), "[^0-9a-f]", "")
    value = F.conv(F.substring(digits, 17, 16), 16, -10).cast("long")
    return F.when(F.substring(digits, 1, 16) == "0" * 16, value)
