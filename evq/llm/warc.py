"""WARC archives: writing, normalising monolithic gzip, reading by index.

Archives are often one gzip stream over many records, in which no record can be
reached without inflating all before it. The normaliser inflates such a stream
once, in blocks, writes every record as a gzip member of its own, and beside the
archive a sidecar with each record's offset, length and identity. Records are
then read by seeking. An archive is one task's work and is never held in memory;
its size is bounded where archives are written here (ARCHIVE_BYTES).

Files are written below the shared folder through ``pyarrow.fs`` under names
that no other attempt uses; only files that a finished task reports are read, so
a lost executor leaves nothing but an unread file.

Defined cases: a null payload is empty; a null url is an empty target; rows that
repeat the largest page_id of a payload are responses each; an empty table gives
no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm.scratch import Scratch, table

#: Bytes of record data after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Archives that a task normalises, and bytes of archives that one reads, where that makes more tasks than there are cores.
ARCHIVES, READ_BYTES = 8, 64 << 20
#: Bytes that are inflated, copied or hashed at a time.
BLOCK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:evq:page:"

INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, target string, payload_digest string, payload_bytes bigint, refers_to string"
_FIELDS = [x.split()[0] for x in INDEX.split(", ")]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def base32_digest(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _header(lines: dict[str, str]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """The bytes of one record: a response with its payload, or a revisit with the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{_RECORD}{'' if page_id is None else page_id}>", "WARC-Date": DATE}
    lines |= {"WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    lines["Content-Length"] = str(len(block))
    return _header(lines) + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows page_id, url, payload, size, sha1, response_id (null: this is the response)."""
        fs, top = _open(folder)
        out, name, count, raw, gzip = None, "", 0, 0, None

        def done() -> pa.RecordBatch:
            out.write(gzip.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [count]})

        for batch in batches:
            for page_id, url, payload, size, sha1, response in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, count, raw, gzip = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                data = record(page_id, url, payload or b"", size, base32_digest(sha1), None if response is None else f"{_RECORD}{response}")
                out.write(gzip.compress(data))
                count, raw = count + 1, raw + len(data)
                if raw >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """archive, records: the monolithic archives made of all ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"))
    # a stored table with its known size lets Spark send it to all executors or else split the page side of a common payload
    many = rows.select("page_id", "sha1", "size").groupBy("sha1", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    many = scratch.save(many.select(F.col("sha1").alias("m_sha1"), F.col("size").alias("m_size"), "response"), "repeated")
    rows = rows.join(many, (F.col("sha1") == F.col("m_sha1")) & (F.col("size") == F.col("m_size")), "left")
    response = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("page_id", "url", F.when(response.isNull(), F.col("payload")).alias("payload"), "size", "sha1", response.alias("response"))
    return scratch.save(rows.mapInArrow(_writer(folder), "archive string, records bigint"), "archives")


class _Inflated:
    """The bytes of a gzip file, of one member or many, read in blocks."""

    def __init__(self, raw, name: str):
        self.raw, self.name, self.buffer, self.inflate, self.ended = raw, name, bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        data = self.inflate.unconsumed_tail or self.inflate.unused_data
        if self.inflate.eof:
            data = data or self.raw.read(BLOCK)
            if not data:
                return False
            self.inflate = zlib.decompressobj(31)
        else:
            data = data or self.raw.read(BLOCK)
            if not data:
                if self.ended:
                    raise ValueError(f"{self.name}: the gzip stream breaks off")
                self.ended = True
        self.buffer += self.inflate.decompress(data, BLOCK)
        return True

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end of the file."""
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError(f"{self.name}: a header breaks off")
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return found

    def read(self, size: int) -> Iterator[bytes]:
        while size:
            while not self.buffer:
                if not self._more():
                    raise ValueError(f"{self.name}: a record breaks off")
            part = bytes(self.buffer[: min(size, BLOCK)])
            del self.buffer[: len(part)]
            size -= len(part)
            yield part


def _records(source: _Inflated) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """Headers (names in lower case), their bytes, and the block of each record; the block must be read before the next record."""
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{source.name}: no record begins with {line[:20]!r}")
        headers, head = {}, line + b"\r\n"
        while field := source.line():
            name, _, value = field.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
            head += field + b"\r\n"
        yield headers, head + b"\r\n", source.read(int(headers["content-length"]))


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                yield normalise_file(archive, folder)

    return run


def normalise_file(archive: str, folder: str) -> pa.RecordBatch:
    """Write ``archive`` anew below ``folder`` with a member for each record and a sidecar ``.idx``; return the index rows."""
    fs, path = _open(archive)
    out_fs, top = _open(folder)
    out_fs.create_dir(top, recursive=True)
    name, rows, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
    with fs.open_input_stream(path, compression=None) as raw, out_fs.open_output_stream(f"{top}/{name}", compression=None) as out:
        for headers, head, block in _records(_Inflated(raw, archive)):
            member, start, http = zlib.compressobj(6, zlib.DEFLATED, 31), offset, b""
            for part in chain([head], block, [b"\r\n\r\n", None]):
                data = member.flush() if part is None else member.compress(part)
                out.write(data)
                offset += len(data)
                if part is not None and part is not head and len(http) < 4096:
                    http += part[:4096]
            size = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", http.partition(b"\r\n\r\n")[0] + b"\r\n")
            refers = headers.get("warc-refers-to")
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            rows.append((f"{folder}/{name}", start, offset - start, headers["warc-record-id"].strip("<>"), headers["warc-type"], headers.get("warc-target-uri", ""), digest, int(size[1]) if size else None, refers and refers.strip("<>")))
    with out_fs.open_output_stream(f"{top}/{name}.idx", compression=None) as side:
        for row in rows:
            side.write(("\t".join("-" if x is None else str(x) for x in row[1:]) + "\n").encode())
    return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(_FIELDS)}, schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([(k, pa.int64() if k in ("offset", "length", "payload_bytes") else pa.string()) for k in _FIELDS])


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """INDEX rows of the archives (column archive, a stored table) as rewritten below ``folder``."""
    # a number of its own, as adaptive execution would join the few bytes of all these rows in one task
    many = archives.count()
    tasks = max(many // ARCHIVES, min(many, archives.sparkSession.sparkContext.defaultParallelism), 1)
    return archives.select("archive").repartitionByRange(tasks, "archive").mapInArrow(_normaliser(folder), INDEX)


def sidecar(path: str) -> list[tuple]:
    """The rows of a sidecar file, offset first."""
    fs, name = _open(path)
    with fs.open_input_stream(name, compression=None) as f:
        return [tuple(None if x == "-" else x for x in line.split("\t")) for line in f.read().decode().splitlines()]


def read_record(file, offset: int, length: int, name: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record in one member of an open archive."""
    file.seek(offset)
    source = _Inflated(io.BytesIO(file.read(length)), name)
    headers, _, block = next(_records(source))
    return headers, b"".join(block)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checked rows of INDEX: a response's payload must have the length and digest that its record claims."""
    at, file = None, None
    for batch in batches:
        keep: list[tuple] = []
        for archive, offset, length, record_id, digest, size, refers in zip(*(batch.column(batch.schema.names.index(k)).to_pylist() for k in ("archive", "offset", "length", "record_id", "payload_digest", "payload_bytes", "refers_to"))):
            if archive != at:
                if file:
                    file.close()
                fs, path = _open(archive)
                at, file = archive, fs.open_input_file(path)
            headers, block = read_record(file, offset, length, archive)
            if headers["warc-record-id"] != f"<{record_id}>":
                raise ValueError(f"{archive}: another record at {offset}")
            if headers["warc-type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                if headers["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"{archive}: the payload at {offset} isn't the one that was written")
            page = lambda x: int(x.removeprefix(_RECORD)) if x and x != _RECORD else None
            keep.append((page(record_id), size, digest, headers["warc-type"], page(refers)))
        columns = list(zip(*keep)) or [[]] * 5
        yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(_PAGES, columns)})
    if file:
        file.close()


_PAGES = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def read_pages(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that INDEX rows (a stored table) point to."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(size // READ_BYTES, index.sparkSession.sparkContext.defaultParallelism)
    # each task reads a stretch of archives from front to back
    index = index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return index.mapInArrow(_reader, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{scratch.path}/monolithic", scratch)
    index = scratch.save(normalise(archives, f"{scratch.path}/normal"), "index")
    scratch.drop("monolithic")
    return read_pages(index)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages),
b AS (SELECT *, CAST(array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', instr('0123456789abcdef', c) * 4 - 3, 4)), '') AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, i * 5 + k + 1, 1) AS INT) * CAST(power(2, 4 - k) AS INT))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM b
"""
