"""WARC archives as a chunked record table.

An archive is a table of chunk rows: record identifier, chunk number, number of
chunks, the bytes of the WARC file that the chunk holds, and the payload's
length and SHA-1 up to and including the chunk.  The chunks of a record, in
order, are its WARC bytes, and records one after another are a WARC file
(``export_files`` writes such files, ``import_files`` reads any).  A payload
beyond ``CHUNK`` bytes becomes several rows, so neither writing nor reading
copies a whole record: both go on chunk by chunk with one running digest, and
compare it with the one that each row carries and the header names.

Flow: payload digests (in the JVM) and row positions are grouped under salts;
of records with equal payloads of at least ``least`` bytes the one with the
smallest page_id is the response, the others are revisits of it and hold no
payload.  Then one pass over the rows writes the table.  Reading needs no
shuffle for records of one chunk; the chunks of longer ones are dealt by record
and sorted, and streamed through the digest.

Skew: a digest may belong to a third of all pages.  It is summed up per salt,
the winner goes to at most ``SALTS`` rows a digest, and pages meet it under
their salt; html never takes part.  Revisits are broadcast only when their
counted number is at most ``FEW``.

Defined cases: null html -> empty payload; null page_id -> after all others, and
null in ``refers_to`` if it is the response; equal page_ids with equal payloads
-> the first row by position is the response, the rest revisit it; null url ->
no target URI; control characters in a url are percent-encoded; an empty table
gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm.sources import materialize
from tokentally.session import scratch_dir

#: Bytes of a record's block in one chunk row.
CHUNK = 64 << 10
#: Payloads of fewer bytes are never revisited.
LEAST = 0
#: Salts under which the pages of one digest meet their response.
SALTS = 64
#: Revisits that are broadcast at most (about 60 bytes each).
FEW = 500_000
#: Bytes of chunk rows handed over at once.
BATCH_BYTES = 4 << 20
#: Longest HTTP header that is looked for in front of a payload.
HTTP_HEAD = 1 << 20
#: WARC-Date of the records, unless another is given.
DATE = "2024-01-01T00:00:00Z"

CHUNKS = "record string, chunk int, chunks int, payload_bytes long, digest binary, data binary"
RECORDS = ("record string, type string, page_id long, url string, date string, payload_bytes long, "
           "payload_digest string, refers_to long, refers_to_record string")
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def urn(record: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, record)}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


# ---- chunks of one record ---------------------------------------------------------------------

class Running:
    """Length and SHA-1 of a payload met piece by piece, behind an HTTP header if there is one."""

    def __init__(self, http: bool):
        self.sha, self.size, self.head, self._held = hashlib.sha1(), 0, b"", b"" if http else None

    def feed(self, piece) -> None:
        if self._held is not None:
            held = self._held + bytes(piece)
            end = held.find(END)
            if end < 0 and len(held) < HTTP_HEAD:
                self._held = held
                return
            self.head, piece, self._held = (held[:end], held[end + 4:], None) if end >= 0 else (b"", held, None)
        self.sha.update(piece)
        self.size += len(piece)


def cut(record: str, head: bytes, http: bool, block: Iterator, length: int, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of a record: ``head`` are its WARC header bytes, ``block`` gives the pieces of its block."""
    n, run = max(1, -(-length // chunk)), Running(http)
    for i in range(n):
        piece = next(block, b"")
        run.feed(piece)
        data = b"".join((head if i == 0 else b"", piece, END if i == n - 1 else b""))
        yield record, i, n, run.size, run.sha.copy().digest(), data


def _pieces(http: bytes, payload, chunk: int) -> Iterator[bytes]:
    """``chunk`` bytes at a time of a header and a payload behind it; only a piece is copied."""
    for at in range(0, len(http) + len(payload), chunk):
        first, end = http[at:at + chunk], at + chunk - len(http)
        yield first + bytes(payload[max(0, at - len(http)):end]) if end > 0 else first


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def page_chunks(record: str, page_id, url, payload, sha1: str, refers: str | None, refers_page, date: str,
                chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of a page: a response with its payload, or a revisit of the record ``refers``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    body = payload if refers is None else b""
    head = _header([
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", urn(record)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _line(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"),
        ("WARC-Profile", None if refers is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if refers is None else urn(refers)),
        ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_page),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(body))])
    found = b""
    for row in cut(record, head, True, _pieces(http, body, chunk), len(http) + len(body), chunk):
        found = row[4]
        yield row
    if refers is None and found != bytes.fromhex(sha1):
        raise ValueError(f"payload of {record} has changed since its digest was taken")


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
    for row in rows:
        held.append(row)
        size += len(row[5])
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


# ---- writing ----------------------------------------------------------------------------------

def identified(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``record``, a name of each row by its place (file and row number): the same in every read."""
    place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    return spark.read.parquet(path).select("page_id", "url", "html", place.alias("record"))


def with_records(pages: DataFrame) -> DataFrame:
    """Any table with ``record``: numbered and written once, as the numbers must not change."""
    return materialize(pages.select("page_id", "url", "html", F.monotonically_increasing_id().cast("string").alias("record")),
                       "warc-rows")


def revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(record, refers, refers_page) of every record whose payload equals that of an earlier one by page_id."""
    html = F.coalesce("html", F.lit(""))
    rows = (records.where(F.octet_length(html) >= least)
            .select("record", "page_id", F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("bytes")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)))
    key = ["digest", "bytes"]
    salted = rows.groupBy(*key, "salt").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")).alias("first"), F.count("*").alias("n"))
    shared = salted.groupBy(*key).agg(F.min("first").alias("best"), F.sum("n").alias("all")).where("all > 1").drop("all")
    places = salted.select(*key, "salt").join(shared, key)        # at most SALTS rows a digest
    return (rows.join(places, [*key, "salt"]).where("record <> best.record")
            .select("record", F.col("best.record").alias("refers"), F.col("best.page_id").alias("refers_page")))


def chunk_rows(records: DataFrame, least: int = LEAST, date: str = DATE, chunk: int = CHUNK) -> DataFrame:
    """The archive of ``records`` (record, page_id, url, html) as chunk rows."""
    again = materialize(revisits(records, least), "revisits")
    if again.count() <= FEW:
        again = F.broadcast(again)
    html = F.coalesce("html", F.lit(""))
    rows = records.join(again, "record", "left").select(
        "record", F.col("page_id").cast("long").alias("page_id"), "url", F.encode(html, "UTF-8").alias("payload"),
        F.sha1(html).alias("sha1"), "refers", F.col("refers_page").cast("long").alias("refers_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("record", "page_id", "url", "payload", "sha1", "refers", "refers_page"))):
                    record, page, url, payload, sha1, refers, refers_page = row
                    yield from page_chunks(record.as_py(), page.as_py(), url.as_py(), memoryview(payload.as_buffer()),
                                           sha1.as_py(), refers.as_py(), refers_page.as_py(), date, chunk)
        yield from _batches(every())

    return rows.mapInArrow(run, CHUNKS)


def write_archive(records: DataFrame, path: str, least: int = LEAST, date: str = DATE, chunk: int = CHUNK) -> str:
    """Write the archive of ``records`` as a table of chunk rows."""
    chunk_rows(records, least, date, chunk).write.parquet(path)
    return path


# ---- reading ----------------------------------------------------------------------------------

def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _int(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def parse(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Records of chunk rows (record, chunk, chunks, payload_bytes, digest, data), each record's in order.

    Holds one chunk; a missing chunk or a digest that differs is an error."""
    fields, run, want = {}, None, 0
    for record, chunk, chunks, size, digest, data in rows:
        if chunk == 0:
            end = bytes(data[:HTTP_HEAD]).find(END)
            fields, data, want = _parsed(bytes(data[:end])), data[end + 4:], 0
            run = Running(fields.get("content-type", "").startswith("application/http"))
        if chunk != want:
            raise ValueError(f"record {record}: chunk {want} is missing")
        want = chunk + 1
        run.feed(data[:-4] if want == chunks else data)
        if (run.size, run.sha.digest()) != (size, bytes(digest)):
            raise ValueError(f"record {record}: chunk {chunk} differs from its digest")
        if want < chunks:
            continue
        kind, want = fields.get("warc-type"), 0
        named = fields.get("warc-payload-digest")
        if kind == "revisit":
            size = _int(_parsed(run.head).get("content-length"))
            found = named
        else:
            found = "sha1:" + base32(run.sha.digest())
            if named is not None and named.startswith("sha1:") and named != found:
                raise ValueError(f"record {record}: payload differs from the digest of its header")
        yield (record, kind, _int(fields.get("x-page-id")), fields.get("warc-target-uri"), fields.get("warc-date"), size,
               found and found.removeprefix("sha1:"), _int(fields.get("x-refers-to-page-id")), fields.get("warc-refers-to"))
    if want:
        raise ValueError("the last record is cut off")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for r, c, n, size, digest, data in zip(*(batch.column(i) for i in range(6))):
            yield r.as_py(), c.as_py(), n.as_py(), size.as_py(), digest.as_py(), memoryview(data.as_buffer())


def records_of(archive: DataFrame) -> DataFrame:
    """The records of an archive table, every payload read and its digest checked."""
    kinds = [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in parse(_rows(batches)):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    archive = archive.select(*[f.split()[0] for f in CHUNKS.split(", ")])
    whole = archive.where("chunks = 1").mapInArrow(run, RECORDS)
    longer = archive.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk")
    return whole.unionByName(longer.mapInArrow(run, RECORDS))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return records_of(spark.read.schema(CHUNKS).parquet(path))


# ---- files ------------------------------------------------------------------------------------

def export_files(archive: DataFrame, folder: str, files: int = 8) -> DataFrame:
    """Write an archive table as ``files`` WARC files, a gzip member a record; gives (file, records, bytes).

    ``folder`` is a path or URI that pyarrow opens on every executor.  A task writes under a name of its
    attempt and renames at the end, so a repeated task leaves one whole file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.warc.gz"
        where.create_dir(root, recursive=True)
        draft, count, size = f"{root}/.{name}-{task.taskAttemptId()}", 0, 0
        with where.open_output_stream(draft, compression=None) as out:
            for _, chunk, chunks, _, _, data in _rows(batches):
                if chunk == 0:
                    pack, count = zlib.compressobj(6, zlib.DEFLATED, 31), count + 1
                piece = pack.compress(data) + (pack.flush() if chunk + 1 == chunks else b"")
                out.write(piece)
                size += len(piece)
        where.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

    dealt = archive.select(*[f.split()[0] for f in CHUNKS.split(", ")]).repartition(files, "record")
    done = dealt.sortWithinPartitions("record", "chunk").mapInArrow(run, "file string, records long, bytes long")
    return materialize(done, "warc-files")


def _inflated(stream, gz: bool) -> Iterator[bytes]:
    """Bytes of a file, of all members of a gzip file; at most ``CHUNK`` of them at a time."""
    pack = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        if not gz:
            yield data
            continue
        while data:
            yield pack.decompress(data, CHUNK)
            data = pack.unconsumed_tail
            if pack.eof:
                data, pack = pack.unused_data, zlib.decompressobj(31)


def file_chunks(name: str, pieces: Iterator[bytes], chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of the records of a WARC file that comes in pieces."""
    held, number = b"", 0

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        held += piece or b""
        return piece is not None

    def block(length: int) -> Iterator[bytes]:
        nonlocal held
        while length:
            want = min(chunk, length)
            while len(held) < want and more():
                pass
            piece, held = held[:want], held[want:]
            if len(piece) < want:
                raise ValueError(f"{name}: record {number} is cut off")
            length -= len(piece)
            yield piece
    while True:
        held = held.lstrip(b"\r\n")
        while held.find(END) < 0 and more():
            held = held.lstrip(b"\r\n")
        end = held.find(END)
        if end < 0:
            if held.strip():
                raise ValueError(f"{name}: a header of record {number} is cut off")
            return
        head, held = held[:end + 4], held[end + 4:]
        fields = _parsed(head)
        length = _int(fields.get("content-length"))
        if not head.startswith(b"WARC/") or length is None:
            raise ValueError(f"{name}: record {number} has no WARC header")
        yield from cut(f"{name}#{number:09d}", head, fields.get("content-type", "").startswith("application/http"),
                       block(length), length, chunk)
        number += 1


def import_files(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all ``*.warc`` and ``*.warc.gz`` files below a folder; a task reads a file as a stream."""
    names = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*")
             .load(folder).select("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, inner = pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)
                with where.open_input_stream(inner, compression=None) as stream:
                    yield from _batches(file_chunks(path, _inflated(stream, path.endswith(".gz")), chunk))

    return names.repartition("path").mapInArrow(run, CHUNKS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back; see the module's docstring."""
    path = write_archive(identified(spark, f"{sf_dir}/pages.parquet"), scratch_dir(spark, "warc"))
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                                            "refers_to")
