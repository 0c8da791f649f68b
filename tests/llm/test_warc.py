"""WARC archives: against a plain loop, as bytes of real WARC files, and damaged."""

import base64
import glob
import gzip
import hashlib
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tokentally.llm import op13_warc as W
from tokentally.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, type string, salt int"


@pytest.fixture
def pages():
    long = "é<p>long page</p>" * 3000
    texts = [None, "", "<p>a</p>", "<p>a</p>", long, long, "x" * 49, "x" * 50, "x" * 51, "\r\n\r\n<p>HTTP/1.1</p>\r\n\r\n", "<p>a</p>"]
    rows = [(i, f"http://h/{i} a\r\nb", t, "t", 1) for i, t in enumerate(texts)]
    return rows + [(None, None, "<p>a</p>", None, None), (None, "u", "only here", None, 2), (None, "u", "only here", None, 2),
                   (2, "u", "<p>a</p>", "t", 1), (7, "u", "other", "t", 1)] + [(100 + i, None, "hot", "t", 1) for i in range(40)]


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by a plain loop."""
    out, first = [], {}
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) < least or data not in first:
            first.setdefault(data, page)
            out.append((page, len(data), digest, "response", None))
        else:
            out.append((page, len(data), digest, "revisit", first[data]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()), key=repr)


def write(spark, tmp_dir, rows, **how):
    return W.write_archive(W.with_records(spark.createDataFrame(rows, PAGES)), f"{tmp_dir}/archive", **how)


@pytest.mark.parametrize("chunk,least", [(W.CHUNK, 0), (50, 0), (7, 9)])
def test_archive_equals_a_plain_loop(spark, tmp_dir, pages, chunk, least):
    path = write(spark, tmp_dir, pages, chunk=chunk, least=least)
    assert got(W.read_archive(spark, path)) == expected(pages, least)
    longest = spark.read.parquet(path).agg(F.max("chunks")).first()[0]
    assert longest > 700 if chunk == 50 else True


def test_query_on_odd_rows(spark, write_tables, pages):
    d = write_tables(pages=(pages, PAGES))
    rows = QUERIES["op13_warc"](spark, d)
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, rows.collect()), key=repr) == expected(pages)


def test_empty_table(spark, write_tables, tmp_dir):
    d = write_tables(pages=([], PAGES))
    assert QUERIES["op13_warc"](spark, d).collect() == []


def records_in(data):
    """Plain reading of WARC bytes: (header fields, block)."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4:]


def test_files_are_warc_and_come_back(spark, tmp_dir, pages):
    path = write(spark, tmp_dir, pages, chunk=50)
    done = W.export_files(spark.read.schema(W.CHUNKS).parquet(path), f"{tmp_dir}/out", files=3)
    assert done.agg(F.sum("records")).first()[0] == len(pages)
    names = sorted(glob.glob(f"{tmp_dir}/out/*.warc.gz"))
    assert len(names) == 3 and not glob.glob(f"{tmp_dir}/out/.part*")
    fields = []
    for name in names:
        with gzip.open(name) as f:
            for head, block in records_in(f.read()):
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK")
                if head["WARC-Type"] == "response":
                    assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    assert payload == b""
                fields.append(head)
    ids = {h["WARC-Record-ID"]: h for h in fields}
    assert len(ids) == len(pages)
    for h in fields:
        if h["WARC-Type"] == "revisit":
            assert ids[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert ids[h["WARC-Refers-To"]]["WARC-Type"] == "response"
    for chunk in (W.CHUNK, 33):
        assert got(W.records_of(W.import_files(spark, f"{tmp_dir}/out", chunk))) == expected(pages)


def test_foreign_file(spark, tmp_dir):
    block = b"software: x\r\n"
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\n" + block + b"\r\n\r\n"
    with open(f"{tmp_dir}/a.warc", "wb") as f:
        f.write(record * 3)
    rows = W.records_of(W.import_files(spark, tmp_dir, 4)).collect()
    assert [(r["type"], r["payload_bytes"]) for r in rows] == [("warcinfo", 13)] * 3
    with pytest.raises(ValueError, match="cut off"):
        list(W.file_chunks("f", iter([record[:-10]])))
    with pytest.raises(ValueError, match="no WARC header"):
        list(W.file_chunks("f", iter([b"GET / HTTP/1.0\r\n\r\n"])))


def test_damage_is_found():
    rows = list(W.page_chunks("r", 1, "u", b"0123456789" * 10, hashlib.sha1(b"0123456789" * 10).hexdigest(), None, None, W.DATE, 30))
    assert len(rows) > 4 and [r[5] for r in W.parse(iter(rows))] == [100]
    with pytest.raises(ValueError, match="missing"):
        list(W.parse(iter(rows[:2] + rows[3:])))
    with pytest.raises(ValueError, match="cut off"):
        list(W.parse(iter(rows[:-1])))
    bad = rows[:3] + [(*rows[3][:5], rows[3][5][:-1] + b"?")] + rows[4:]
    with pytest.raises(ValueError, match="differs"):
        list(W.parse(iter(bad)))


def test_a_long_record_is_streamed():
    size, piece = 64 << 20, b"x" * W.CHUNK
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % size

    def pieces():
        yield head
        for _ in range(size // len(piece)):
            yield piece
        yield W.END
    tracemalloc.start()
    rows = list(W.parse(W.file_chunks("f", pieces())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[0][5] == size and peak < 4 << 20
