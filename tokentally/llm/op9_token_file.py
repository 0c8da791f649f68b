"""Token-ID / binary output: fixed-width bit packing.

Every id takes the least number of bits that holds the vocabulary.  Ids are
written in ascending document order as rows of a Parquet table, one row a
block: which documents it holds, the ids of each, and the packed bits.  Blocks
hold whole documents, so they are read independently and unpacked with numpy;
``read_range`` fetches any span of the global id sequence by block offset.

Flow: range-partition by document id, sort inside the partitions, encode and
pack (one pass), write; block offsets come from the per-partition totals (one
number a partition).  No document set meets in one task: repeated document ids
are dealt out by a hash of the text as second key.

Defined cases: null or empty text -> only the end id; null doc_id sorts first;
equal doc_ids are ordered by text hash; an empty table gives an empty file set;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.subwords import default_tokenizer, encoder
from tokentally.session import scratch_dir

#: Ids of a block (a longer document is a block of its own).
BLOCK_IDS = 1 << 16
#: Id after every document.
END_ID = 0

BLOCK_SCHEMA = ("part int, block int, width int, n_ids long, doc_ids array<long>, "
                "doc_tokens array<int>, payload binary")


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits an id, little-endian bit order."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, n: int, width: int, start: int = 0) -> np.ndarray:
    """``n`` ids from id ``start`` of a packed payload."""
    first = start * width
    raw = np.frombuffer(payload, np.uint8)[first // 8:(first + n * width + 7) // 8]
    if width == 16:
        return raw.view("<u2").astype(np.uint32)
    bits = np.unpackbits(raw, bitorder="little")[first % 8:first % 8 + n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _block(part: int, number: int, width: int, doc_ids: list, counts: list, ids: list) -> pa.RecordBatch:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([width], pa.int32()),
         pa.array([len(flat)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
         pa.array([counts], pa.list_(pa.int32())), pa.array([pack(flat, width)], pa.binary())],
        names=["part", "block", "width", "n_ids", "doc_ids", "doc_tokens", "payload"])


def _packer(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = width_of(enc.vocab_size)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, counts, held, size = [], [], [], 0
        for batch in textops.chunks(batches, "text"):
            flat, n = enc.encode_bytes(*textops.utf8(batch.column("text")))
            ends = np.cumsum(n)
            for doc, count, end in zip(batch.column("doc_id").to_pylist(), n.tolist(), ends.tolist()):
                if size and size + count + 1 > block_ids:
                    yield _block(part, number, width, doc_ids, counts, held)
                    number, doc_ids, counts, held, size = number + 1, [], [], [], 0
                held += [flat[end - count:end], np.array([end_id], np.int32)]
                doc_ids.append(doc)
                counts.append(count + 1)
                size += count + 1
        if doc_ids:
            yield _block(part, number, width, doc_ids, counts, held)
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the packed blocks under ``path``."""
    tokenizer = tokenizer or default_tokenizer()
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .withColumn("tie", F.xxhash64("text"))
     .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
     .drop("tie")
     .mapInArrow(_packer(tokenizer, end_id, block_ids), BLOCK_SCHEMA)
     .write.mode("overwrite").parquet(path))


def read_blocks(spark, path: str) -> DataFrame:
    """The blocks with ``start``, the global index of their first id.

    Two steps of running sums: over the blocks of a partition, and over the
    partitions' totals (one row a partition).
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    inner = Window.partitionBy("part").orderBy("block")
    parts = (blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
             .withColumn("part_start", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))
             .select("part", "part_start"))
    # the running sum moves only the small columns; payloads stay where they are until the join
    offsets = (blocks.select("part", "block", "n_ids")
               .withColumn("inner_start", F.sum("n_ids").over(inner) - F.col("n_ids"))
               .join(parts, "part")
               .select("part", "block", (F.col("part_start") + F.col("inner_start")).alias("start")))
    return blocks.join(offsets, ["part", "block"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).to_pydict()
            counts = np.array(row["doc_tokens"][0], np.int64)
            ids = unpack(row["payload"][0], row["n_ids"][0], row["width"][0]).astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c:e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"][0], pa.int64()), pa.array(row["start"][0] + ends - counts, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(spark, path: str) -> DataFrame:
    """One row a document, unpacked from the files: start, number of ids and their crc32."""
    return read_blocks(spark, path).mapInArrow(
        _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark, path: str, start: int, n: int) -> DataFrame:
    """Ids ``start`` .. ``start+n-1`` of the global sequence as (position, id); other blocks are not unpacked."""
    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pydict()
                lo = max(start, row["start"][0])
                hi = min(start + n, row["start"][0] + row["n_ids"][0])
                ids = unpack(row["payload"][0], hi - lo, row["width"][0], lo - row["start"][0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(lo, hi), pa.int64()), pa.array(ids.astype(np.int64), pa.int64())],
                    names=["position", "id"])
    hit = read_blocks(spark, path).where((F.col("start") < start + n) & (F.col("start") + F.col("n_ids") > start))
    return hit.mapInArrow(cut, "position long, id long")


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    """All documents written as packed token files and read back."""
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' ids as a packed file, and its digest per document."""
    path = scratch_dir(spark, "token-file")
    write_tokens(docs, path)
    return digest(spark, path)
