"""Mixing sources to target weights by fixed-length blocks.

The words of a source, in a fixed pseudorandom document order, are packed into
blocks of ``block_words`` words.  Every source gets a target (its share of the
mix by weight, at most ``max_repeat`` times its size; the excess is shared anew
by weight).  Output shards draw multinomial source counts; a draw makes the
shard own the source's next slots.  Slot k of a source maps to a block through
the source's pseudorandom permutation of block numbers (one permutation a pass),
and blocks are joined by their number.  Draws beyond a source's quota are not
used, and slots that no shard drew go to top-up shards at the end, so every
source ends within one block of its target whatever the draws.

Skew: a source may hold a third of all words.  Offsets inside a source are
running sums in two steps (over ``buckets`` hash buckets, then inside a
bucket), those of the shards' draws are split by range of shards, and slots and blocks join on (source, block), of which a block holds
at most ``block_words`` documents.  The driver sees one row a source.

Defined cases: null text -> size 0, taken 0; null source is a source of its own
(last in order); repeated rows are separate documents; an empty table or
targets of 0 give taken 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.sources import materialize
from tokentally.operators.running import range_sums

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix; ``weights`` repeat over the sources in order of name, null last."""
    weights: Sequence[int] = (5, 2, 1)
    total_ratio: float = 1.5
    max_repeat: float = 2.0
    block_words: int = 64
    shard_blocks: int = 1024
    buckets: int = 4096
    seed: int = 20


def targets(sizes: Sequence[int], mix: Mix) -> list[float]:
    """Target of each source: weight shares of the total, capped, the excess reshared until none is above."""
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    caps = [mix.max_repeat * n for n in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), mix.total_ratio * sum(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w >= caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_.difference_update(over)
    return out


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """(rid, doc_id, source, size, offset): words of every document and its first word in its source.

    ``rid`` tells rows apart: document id, text hash and the number among equal rows.
    """
    same = Window.partitionBy("doc_id", "th", "source").orderBy("size")
    inner = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "th", "dup")
    outer = Window.partitionBy("source").orderBy("bucket")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.xxhash64("text").alias("th"),
                        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
            .withColumn("dup", F.row_number().over(same))
            .withColumn("order", F.xxhash64(F.lit(mix.seed), "doc_id", "th", "dup"))
            .withColumn("bucket", F.pmod("order", F.lit(mix.buckets)).cast("int")))
    rows = rows.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    starts = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
              .withColumn("bucket_start", F.sum("n").over(outer) - F.col("n"))
              .select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "bucket_start"))
    return (rows.join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
            .select("doc_id", "th", "dup", "source", "size", (F.col("bucket_start") + F.col("within")).alias("offset")))


def quota_slots(size: int, target: float, block_words: int) -> int:
    """Slots whose words come nearest to the target: whole passes, then blocks of the next pass."""
    if size == 0:
        return 0
    blocks = -(-size // block_words)
    passes = int(target // size)
    return passes * blocks + min(blocks, round((target - passes * size) / block_words))


def _draws(shares: list[float], shard_blocks: int, seed: int):
    """Multinomial source counts of each output shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng([seed, shard]).multinomial(shard_blocks, shares)
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), shard), pa.int64()), pa.array(hit, pa.int32()),
                     pa.array(counts[hit], pa.int64())], names=["shard", "sid", "n"])
    return run


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 by ``key``: a four-round Feistel net with cycle walking."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = key.astype(np.uint64)
    x = index.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        b, m, v = bits[todo], mask[todo], x[todo]
        left, right = v >> b, v & m
        for r in range(4):
            f = textops.mix64(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
            left, right = right, left ^ (f & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def source_keys(names: Sequence[str | None], seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{name!r}".encode()).digest()[:7], "big") for name in names]


def _slot_blocks(blocks: list[int], keys: list[int]):
    """Adds block and pass of every slot."""
    n_of, key_of = np.array(blocks, np.int64), np.array(keys, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid = batch.column("sid").to_numpy()
            slot = batch.column("slot").to_numpy()
            n = n_of[sid]
            pass_ = slot // n
            block = permute(slot % n, n, key_of[sid] + pass_)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("sid"), batch.column("slot"),
                 pa.array(pass_, pa.int32()), pa.array(block, pa.int64())],
                names=["shard", "sid", "slot", "pass", "block"])
    return run


def plan_slots(spark: SparkSession, names, sizes, goals, mix: Mix) -> DataFrame:
    """(shard, sid, slot, pass, block): the mix as a table of block uses."""
    quotas = [quota_slots(n, t, mix.block_words) for n, t in zip(sizes, goals)]
    total = sum(quotas)
    schema = "shard long, sid int, slot long, pass int, block long"
    if total == 0:
        return spark.createDataFrame([], schema)
    shards = -(-total // mix.shard_blocks)
    draws = spark.range(shards).mapInArrow(
        _draws([q / total for q in quotas], mix.shard_blocks, mix.seed), "shard long, sid int, n long")
    quota = spark.createDataFrame([(i, q) for i, q in enumerate(quotas)], "sid int, quota long")
    # a source's draws of all shards, split by range of shards
    drawn = (range_sums(draws, "sid", ["shard"], ("n",)).withColumn("first", F.col("run_n") - F.col("n"))
             .join(quota, "sid"))
    used = drawn.select("shard", "sid", "first", F.least(F.col("first") + F.col("n"), "quota").alias("end"))
    met = draws.groupBy("sid").agg(F.sum("n").alias("met"))
    rest = (quota.join(met, "sid", "left")
            .withColumn("met", F.coalesce("met", F.lit(0))).where("met < quota")
            # a top-up shard holds at most shard_blocks slots of a source
            .withColumn("first", F.explode(F.expr(f"sequence(met, quota - 1, {mix.shard_blocks}L)")))
            .select((F.lit(shards) + F.floor((F.col("first") - F.col("met")) / mix.shard_blocks)).alias("shard"),
                    "sid", "first", F.least(F.col("first") + mix.shard_blocks, "quota").alias("end")))
    slots = (used.unionByName(rest).where("first < end")
             .select("shard", "sid", F.explode(F.expr("sequence(first, end - 1)")).alias("slot")))
    blocks = [max(1, -(-n // mix.block_words)) for n in sizes]
    return slots.mapInArrow(_slot_blocks(blocks, source_keys(names, mix.seed)), schema)


@dataclass
class Mixed:
    """A mix: ``rows`` are the documents (doc_id, th, dup, sid, source, size, offset, source_size, target);
    ``uses`` the document pieces of each used block (shard, slot, pass, block and the words of the document)."""
    rows: DataFrame
    uses: DataFrame

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words that the mix takes of each, repeats counted."""
        key = ["doc_id", "th", "dup", "sid"]
        t = self.uses.groupBy(*key).agg(F.sum("n_words").alias("taken"))
        r, t = self.rows.alias("r"), t.alias("t")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key]
        return (r.join(t, same, "left")
                .select("r.doc_id", "r.th", "r.dup", "r.sid", "r.source", "r.size", "r.offset", "r.source_size",
                        "r.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> Mixed:
    """Plan the mix of ``docs(doc_id, text, source)``."""
    spark = docs.sparkSession
    rows = materialize(sized(docs, mix), "mix-rows")
    # one row a source: the mixing table is configuration, not data
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    names, sizes = [r["source"] for r in found], [int(r["n"]) for r in found]
    goals = targets(sizes, mix)
    dim = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(names, sizes, goals))],
                                "sid int, s2 string, source_size long, target double")
    rows = (rows.join(dim, F.col("source").eqNullSafe(F.col("s2")))
            .select("doc_id", "th", "dup", "sid", "source", "size", "offset", "source_size", "target"))
    b = mix.block_words
    pieces = (rows.where("size > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(offset div {b}, (offset + size - 1) div {b})")))
              .withColumn("from_word", F.greatest(F.col("block") * b - F.col("offset"), F.lit(0)))
              .withColumn("n_words", F.least("size", (F.col("block") + 1) * b - F.col("offset")) - F.col("from_word"))
              .select("sid", "block", "doc_id", "th", "dup", "size", "from_word", "n_words"))
    uses = plan_slots(spark, names, sizes, goals, mix).join(pieces, ["sid", "block"])
    return Mixed(rows, uses)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut to the word runs of each pass; the other columns pass through."""
    for batch in textops.chunks(batches, "text"):
        raw, off = textops.utf8(batch.column("text"))
        starts, ends, word_off = textops.words(raw, off)
        texts = batch.column("text")
        out, sizes = [], batch.column("size").to_pylist()
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            if sum(r["n"] for r in runs) == sizes[i]:
                out.append(texts[i].as_py())
                continue
            runs.sort(key=lambda r: r["from"])
            cut, last = [], None
            for r in runs:
                lo, hi = word_off[i] + r["from"], word_off[i] + r["from"] + r["n"] - 1
                if last is not None and r["from"] == last:
                    cut[-1][1] = hi
                else:
                    cut.append([lo, hi])
                last = r["from"] + r["n"]
            out.append("\n".join(raw[starts[lo]:ends[hi]].tobytes().decode() for lo, hi in cut))
        keep = [n for n in batch.schema.names if n not in ("text", "runs", "size")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            + [batch.column(n) for n in keep], names=["text", "mixed_chars", *keep])


def mix_texts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed documents with the columns of ``docs``: one row per document and pass that takes words of it.

    A pass that takes the whole document keeps its text as it is; else the text holds the taken word runs,
    joined by a line end, and ``n_chars`` (if there) is counted anew.  Documents without words are kept once.
    """
    spec = mix_sources(docs, mix)
    runs = (spec.uses.groupBy("doc_id", "th", "dup", "sid", "pass", "size")
            .agg(F.collect_list(F.struct(F.col("from_word").alias("from"), F.col("n_words").alias("n"))).alias("runs"))
            .join(spec.rows.select("sid", "source").distinct(), "sid"))
    empty = (spec.rows.where("size = 0")
             .select("doc_id", "th", "dup", "source", "size", F.lit(0).alias("pass"),
                     F.expr("cast(array() as array<struct<`from`: bigint, n: bigint>>)").alias("runs")))
    runs = runs.select("doc_id", "th", "dup", "source", "size", "pass", "runs").unionByName(empty).alias("r")
    names = docs.columns
    same = Window.partitionBy("_id", "_th", "_source").orderBy("_id")
    d = (docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)],
                     F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"),
                     F.col("source").cast("string").alias("_source"))
         .withColumn("_dup", F.row_number().over(same)))
    joined = d.join(runs, [d._id.eqNullSafe(F.col("r.doc_id")), d._th == F.col("r.th"), d._dup == F.col("r.dup"),
                           d._source.eqNullSafe(F.col("r.source"))])
    at = names.index("text")
    rest = [f"c_{i}" for i in range(len(names)) if i != at]
    cut = joined.select(F.coalesce(F.col(f"c_{at}"), F.lit("")).alias("text"), "r.runs", "r.size", *rest)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = "text string, mixed_chars long, " + ", ".join(f"{c} {kinds[c]}" for c in rest)
    done = cut.mapInArrow(_cut, schema)
    return done.select(*[
        (F.col("text") if c == "text" else F.col("mixed_chars").cast(docs.schema[c].dataType) if c == "n_chars"
         else F.col(f"c_{i}")).alias(c) for i, c in enumerate(names)])


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as mixed."""
    return mix_texts(docs)
