"""WARC archives as a chunked record table.

Payloads travel as rows of record identifier and chunk number; writers and readers hold one chunk and a
running digest, never a whole record. Records are gzip members of their own; files are listed in a
manifest that only committed tasks write, so the files of a lost executor's attempt are never read.

Defined results: a NULL payload is empty; a NULL page id is written as ``null`` and never becomes the
response that others refer to; rows that repeat the response's id are responses as well; an empty table
gives no archive; extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import stage, stage_dir

CHUNK = 64 << 10
#: Smallest payload that a revisit record may stand for.
REVISIT_BYTES = 1000
#: A writer begins a new file beyond this many bytes.
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_records long"
RECORDS = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
           "payload_digest string, declared_digest string, chunk_no int, last boolean")


def records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html",
            revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One row per page: id, url, payload, its length and SHA-1, and the page that a revisit refers to."""
    data = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id}`").alias("page"), F.col(f"`{url}`").alias("url"), data.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    first = (rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes")
             .agg(F.max("page").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"))
    refers = F.when(F.col("page").eqNullSafe(F.col("response")), None).otherwise(F.col("response"))
    return rows.join(first, ["digest", "bytes"], "left").withColumn("refers_to", refers).drop("response")


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Records as rows of chunk numbers, consecutive within a record; a revisit has one empty chunk."""
    own = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    number = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("own") / size) - 1, F.lit(0)).cast("int")))
    cut = rows.withColumn("own", own).select("page", "url", "bytes", "digest", "refers_to", "own", number.alias("chunk_no"))
    return cut.withColumn("data", F.substring("own", F.col("chunk_no") * size + 1, F.lit(size))).drop("own")


def _urn(page, digest: str) -> str:
    return f"<urn:page:{'null' if page is None else page}:{digest}>"


def _head(page, url, size: int, digest: str, refers) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
             f"WARC-Record-ID: {_urn(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {_urn(refers, digest)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pieces: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows as archives below ``folder``; returns the manifest of committed files."""
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        out = name = member = None
        count = size = 0

        def close():
            out.write(member.compress(b"\r\n\r\n") + member.flush())

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            data = batch.column(6)
            for k, (page, url, bytes_, digest, refers, number) in enumerate(zip(*columns)):
                if number == 0:
                    if member is not None:
                        close()
                    if out is None or size > file_bytes:
                        if out is not None:
                            out.close()
                            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [count]})
                        store.create_dir(root, recursive=True)
                        leaf = f"pages-{uuid.uuid4().hex}.warc.gz"
                        name, count, size = f"{folder}/{leaf}", 0, 0
                        out = store.open_output_stream(f"{root}/{leaf}", compression=None)
                    member = zlib.compressobj(1, wbits=31)
                    count += 1
                    out.write(member.compress(_head(page, url, bytes_, digest, refers)))
                packed = member.compress(data[k].as_buffer())
                size += len(packed)
                out.write(packed)
        if out is not None:
            close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [count]})

    ordered = pieces.select("page", "url", "bytes", "digest", "refers_to", "chunk_no", "data")
    return stage(ordered.mapInArrow(run, MANIFEST))


class _Stream:
    """Bytes of a file of gzip members, a bounded buffer at a time."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.raw = source, zlib.decompressobj(31), b"", b""

    def fill(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.source.read(CHUNK)
                self.inflate = zlib.decompressobj(31)
            else:
                self.raw = self.inflate.unconsumed_tail or self.source.read(CHUNK)
            if not self.raw:
                return False
            new = self.inflate.decompress(self.raw, CHUNK)
            if new:
                self.held += new
                return True

    def head(self) -> dict[str, str] | None:
        """Header fields up to the empty line; None at the end of the file."""
        while b"\r\n\r\n" not in self.held:
            if not self.fill():
                if self.held.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        text, self.held = self.held.split(b"\r\n\r\n", 1)
        return dict(x.split(": ", 1) for x in text.decode().split("\r\n")[1:])

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes."""
        if not self.held and not self.fill():
            raise ValueError("an archive ends inside a record")
        part, self.held = self.held[:n], self.held[n:]
        return part


def parse(source, size: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of one archive: RECORDS and the chunk's bytes."""
    stream = _Stream(source)
    while (head := stream.head()) is not None:
        body = stream.head()
        left = n = int(body["Content-Length"])
        kind, declared = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        running, number = hashlib.sha1(), 0
        refers = head.get("WARC-Refers-To")
        fixed = (head["WARC-Record-ID"], kind, head.get("WARC-Target-URI"), refers)
        if kind == "revisit":
            yield (*fixed, n, declared, declared, 0, True, b"")
        else:
            while True:
                data = b""
                while left and len(data) < size:
                    part = stream.take(min(left, size - len(data)))
                    left -= len(part)
                    data += part
                running.update(data)
                yield (*fixed, n - left, running.hexdigest(), declared, number, not left, data)
                number += 1
                if not left:
                    break
            if running.hexdigest() != declared:
                raise ValueError(f"payload of {fixed[0]} does not have its declared digest")
        while len(stream.held) < 4:
            if not stream.fill():
                raise ValueError("an archive ends inside a record")
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"{fixed[0]} is longer than declared")


def read_archives(manifest: DataFrame, data: bool = True) -> DataFrame:
    """Chunk rows of the manifest's files: length and digest run along; ``last`` marks a record's end.

    With ``data=False`` only the last row of each record comes out, without payload bytes.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["data"] * data
    schema = RECORDS + (", data binary" if data else "")
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()] + [pa.binary()] * data

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as source:
                    rows, held = [], 0
                    for row in parse(source):
                        if data or row[8]:
                            rows.append(row if data else row[:-1])
                            held += len(row[-1]) if data else 0
                        if held > (4 << 20) or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return manifest.repartition("path").select("path").mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    root = stage_dir(spark).rstrip("/")
    return f"{root if '://' in root or root.startswith('/') else '/' + root}/warc-{uuid.uuid4().hex}"


def page_of(column: str, kind: str):
    """The page id inside a record id."""
    value = F.regexp_extract(column, r"^<urn:page:(.*):[0-9a-f]{40}>$", 1)
    return F.when(F.col(column).isNotNull() & (value != "null"), value).cast(kind)
