"""Source divergence audit by iceberg prefix refinement.

The terms that a language keeps (those in at least ``LEAST`` of its documents)
are found level by level: a pass counts the distinct documents of every byte
prefix of ``level`` bytes, prefixes below the threshold are discarded, and the
next pass, with prefixes twice as long, looks only at terms that begin with a
prefix that is left.  A term no longer than the level is complete, and its count
is exact.  The levels end when no longer prefix is left.  Discarding goes by a
bitmap of prefix hashes of fixed size: a false hit only costs a count, and
nothing is missed, so the kept terms are exact however many there are.  Each
pass counts in its task first; from the third level on it reads only what the
levels before left of the documents.

The audit then compares, in whole numbers, the smoothed term shares of all
sources of a language with each other (``pair``) and with their language
(``term``).  A pair's sum over all kept terms runs over tiles of ``TILE`` by
``TILE`` sources and buckets of terms as dense matrices; a term that no source
of a tile pair holds adds the same to the pair each time and is multiplied in.

Skew: one language or source may hold most documents.  Counts are summed in the
tasks and per key by Spark; a group's numbers meet its terms under ``SALTS``
salts; buckets hold about ``BUCKET_ROWS`` rows whatever the vocabulary; the top
terms are cut per task before they are shuffled.

Defined cases: null text, lang or source counts as ''; a document is a row, so
repeated rows and rows of equal or null doc_id count each; a language without
kept terms has pair values of 0; an empty table gives no row; ties rank by the
item's UTF-8 bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.sources import materialize, table

#: Documents of a language that must hold a kept term.
LEAST = 3
#: Bytes of the prefixes of the first level; each level doubles it.
FIRST_LEVEL = 4
#: Bits of the bitmap of prefixes that are left (8 MB).
BITMAP_BITS = 1 << 26
#: Ranks of the ``term`` part.
TOP = 200
#: Share of 1 in the whole numbers.
UNIT = 1_000_000_000
#: Rows that a task holds before its counts go on.
HELD_ROWS = 1 << 20
#: Sources in a tile, terms in a dense block, rows in a bucket of terms.
TILE, DENSE_TERMS, BUCKET_ROWS = 256, 1024, 1 << 17
#: Salts under which a group's numbers meet its terms.
SALTS = 16

COUNTS = "lang string, source string, term binary, whole boolean, n_docs long, n long"
_KINDS = [pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in COUNTS.split(", ")]

_TERM = np.zeros(256, bool)
_TERM[np.r_[65:91, 97:123, 128:256]] = True


# ---- terms of a chunk of documents ------------------------------------------------------------

def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text number of every term, the distinct terms (lower-cased A-Z), and which of them it is."""
    solid = _TERM[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    doc = np.searchsorted(off, at, side="right") - 1
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) > 1) | (np.diff(doc) > 0)
    starts = np.flatnonzero(first)
    data = textops.LOWER[raw[at]]
    offsets = np.append(starts, len(at)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return doc[starts], coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hashes(langs: list[str], lang_at: np.ndarray, prefixes: pa.Array) -> np.ndarray:
    """Bit of each (language, prefix)."""
    raw, off = _bytes(prefixes)
    own = np.zeros(len(prefixes), np.uint64)
    solid = np.flatnonzero(np.diff(off))
    own[solid] = textops.hash_spans(raw, off[:-1][solid], off[1:][solid])
    lraw, loff = _bytes(pa.array([x.encode() + b"." for x in langs], pa.large_binary()))
    lang = textops.hash_spans(lraw, loff[:-1], loff[1:])
    return (textops.mix64(own ^ textops.mix64(lang + np.uint64(1))[lang_at]) % np.uint64(BITMAP_BITS)).astype(np.int64)


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = pa.concat_arrays([col.cast(pa.large_binary())])
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _codes(col: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(col.cast(pa.string()), "").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Chunk:
    """The (language, term) pairs of some documents that may still be kept: longer than ``done`` bytes, and
    with a prefix of that length that is left."""

    def __init__(self, batch: pa.RecordBatch, done: int, left: bytes | None):
        self.langs, lang = _codes(batch.column("lang"))
        self.sources, source = _codes(batch.column("source"))
        self.lang, self.group = lang, lang * max(1, len(self.sources)) + source
        doc, self.terms, code = terms_of(*textops.utf8(batch.column("text")))
        u = max(1, len(self.terms))
        pairs, pair = np.unique(lang[doc] * u + code, return_inverse=True)
        self.pair_lang, self.pair_term = pairs // u, pairs % u
        self.length = (pc.binary_length(self.terms).to_numpy(zero_copy_only=False).astype(np.int64)[self.pair_term]
                       if len(pairs) else np.zeros(0, np.int64))
        if left is not None:
            keep = self.length > done
            at = np.flatnonzero(keep)
            bits = hashes(self.langs, self.pair_lang[at], self.prefix(at, done)) if len(at) else at
            keep[at] = (np.frombuffer(left, np.uint8)[bits >> 3] >> (bits & 7)) & 1 == 1
            inside = keep[pair]
            doc, pair = doc[inside], pair[inside]
        self.doc, self.pair = doc, pair

    def prefix(self, pairs: np.ndarray, size: int) -> pa.Array:
        return pc.binary_slice(self.terms.take(pa.array(self.pair_term[pairs])), 0, size)

    def counts(self, level: int) -> pa.Table:
        """Documents and occurrences of the complete terms by group, documents of the longer ones' prefixes."""
        n = max(1, len(self.pair_term))
        places, times = np.unique(self.doc * n + self.pair, return_counts=True)
        doc, pair = places // n, places % n
        short = self.length[pair] <= level
        by_group, at = np.unique(self.group[doc[short]] * n + pair[short], return_inverse=True)
        g, p, s = by_group // n, by_group % n, max(1, len(self.sources))
        whole = [_take(self.langs, g // s), _take(self.sources, g % s), self.terms.take(pa.array(self.pair_term[p])).cast(pa.binary()),
                 pa.array(np.ones(len(p), bool)), pa.array(np.bincount(at, minlength=len(p)), pa.int64()),
                 pa.array(np.bincount(at, weights=times[short], minlength=len(p)).astype(np.int64))]
        doc, pair = doc[~short], pair[~short]
        used, pair = np.unique(pair, return_inverse=True)
        cut = self.prefix(used, level).dictionary_encode()
        m = max(1, len(cut.dictionary))
        own = self.pair_lang[used] * m + cut.indices.to_numpy(zero_copy_only=False)
        keys, key = np.unique(own, return_inverse=True)
        k = max(1, len(keys))
        seen = np.unique(doc * k + key[pair]) % k if len(doc) else np.zeros(0, np.int64)
        part = [_take(self.langs, keys // m), pa.nulls(len(keys), pa.string()), cut.dictionary.take(pa.array(keys % m)).cast(pa.binary()),
                pa.array(np.zeros(len(keys), bool)), pa.array(np.bincount(seen, minlength=len(keys)), pa.int64()),
                pa.array(np.zeros(len(keys), np.int64))]
        return pa.concat_tables([pa.Table.from_arrays(a, names=_NAMES) for a in (whole, part)])

    def rest(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The documents with the terms of this chunk alone, apart by spaces."""
        words = self.terms.take(pa.array(self.pair_term[self.pair])).cast(pa.string())
        ends = np.searchsorted(self.doc, np.arange(batch.num_rows + 1))
        lists = textops.list_array(words, ends, pa.string())
        text = pc.binary_join(lists, " ") if batch.num_rows else pa.array([], pa.string())
        used = pa.array(np.diff(ends) > 0)
        return pa.RecordBatch.from_arrays([pc.fill_null(batch.column("lang"), ""), pc.fill_null(batch.column("source"), ""), text],
                                          names=["lang", "source", "text"]).filter(used)


def _take(names: list[str], at: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(at))


def summed(held: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(held).group_by(["lang", "source", "term", "whole"], use_threads=False).aggregate(
        [("n_docs", "sum"), ("n", "sum")])
    return got.select(["lang", "source", "term", "whole", "n_docs_sum", "n_sum"]).rename_columns(_NAMES)


# ---- levels -----------------------------------------------------------------------------------

def level_counts(docs: DataFrame, level: int, done: int, left, least: int) -> DataFrame:
    """Exact counts of one level: (lang, source, term, whole, n_docs, n), whole terms of the language's
    threshold by source, longer prefixes of it with a null source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in textops.chunks(batches, "text"):
            held.append(Chunk(batch, done, left and left.value).counts(level))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [summed(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
        if rows:
            yield from summed(held).to_batches(1 << 16)

    key = ["lang", "source", "term", "whole"]
    counts = docs.mapInArrow(run, COUNTS).groupBy(*key).agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    counts = materialize(counts, f"level-{level}")
    enough = counts.groupBy("lang", "term", "whole").agg(F.sum("n_docs").alias("df")).where(F.col("df") >= least)
    return materialize(counts.join(enough, ["lang", "term", "whole"]).select(*_NAMES), f"left-{level}")


def bitmap(prefixes: DataFrame) -> bytes:
    """The bits of all (lang, term) rows, set in Spark in blocks of 4 KB; ``BITMAP_BITS`` / 8 bytes whatever they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(hashes(*_codes(batch.column("lang")), batch.column("term")))], names=["bit"])

    bits = prefixes.select("lang", "term").mapInArrow(run, "bit long")
    blocks = bits.groupBy(F.shiftright("bit", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for row in blocks.toLocalIterator():
        out[row["block"] * 4096:row["block"] * 4096 + 4096] = row["bits"]
    return bytes(out)


def rest_of(docs: DataFrame, done: int, left) -> DataFrame:
    """What the levels so far leave of the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "text"):
            yield Chunk(batch, done, left.value).rest(batch)

    return materialize(docs.mapInArrow(run, "lang string, source string, text string"), "rest")


def kept_terms(docs: DataFrame, least: int = LEAST, first: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, term, n) of every kept term of ``docs`` (lang, source, text) and source that has it."""
    spark, level, done, left, parts = docs.sparkSession, first, 0, None, []
    while True:
        counts = level_counts(docs, level, done, left, least)
        parts.append(counts.where("whole").select("lang", "source", "term", "n"))
        longer = counts.where("not whole")
        if longer.isEmpty():
            break
        seen, left = left, spark.sparkContext.broadcast(bitmap(longer))
        if seen is not None:
            docs = rest_of(docs, level, left)
            seen.unpersist()
        level, done = level * 2, level
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    return kept


# ---- divergence -------------------------------------------------------------------------------

def _share(count: str, total: str, v: str):
    """1 + floor(UNIT * (count + 1) / (total + v)), exact."""
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} + {v} as decimal(19,0))")


def _pair_sums(langs: DataFrame, rows: DataFrame, buckets: int, tile: int) -> DataFrame:
    """(lang, a, b, value, seen): sums over the terms of the tiles of a and b, and how many terms those are.

    ``rows``: (lang, term, idx, p) of every source's own terms; ``langs``: (lang, idx, z, tiles)."""
    def both(df: DataFrame) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        own = F.expr(f"idx div {tile}")
        return (df.withColumn("_other", other).withColumn("ta", F.least(own, F.col("_other")))
                .withColumn("tb", F.greatest(own, F.col("_other"))).select("lang", "ta", "tb", "bucket", "term", "idx", "p"))

    empty = langs.select("lang", "idx", F.lit(None).cast("binary").alias("term"), F.col("z").alias("p"), "tiles",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    own = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("long"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        idx, p = group["idx"].to_numpy(), group["p"].to_numpy()
        no_term = group["term"].is_null().to_numpy(zero_copy_only=False)
        sources = np.sort(idx[no_term])
        z = p[no_term][np.argsort(idx[no_term])]
        column = np.searchsorted(sources, idx[~no_term])
        coded = group["term"].filter(pa.array(~no_term)).combine_chunks().dictionary_encode()
        term, p = coded.indices.to_numpy(zero_copy_only=False), p[~no_term]
        order = np.argsort(term, kind="stable")
        term, column, p = term[order], column[order], p[order]
        n, total = len(coded.dictionary), np.zeros((len(sources), len(sources)), np.int64)
        ta, tb = group["ta"][0].as_py(), group["tb"][0].as_py()
        part = sources // tile
        for lo in range(0, n, DENSE_TERMS):
            a, b = np.searchsorted(term, [lo, lo + DENSE_TERMS])
            dense = np.repeat(z[None, :], min(DENSE_TERMS, n - lo), axis=0)
            dense[term[a:b] - lo, column[a:b]] = p[a:b]
            for i in range(len(sources)):
                others = slice(None) if ta == tb else part != part[i]
                q = dense[:, others]
                total[i, others] += ((dense[:, i:i + 1] - q) ** 2 // q).sum(axis=0)
        i, j = np.nonzero((part[:, None] != part[None, :]) if ta != tb else ~np.eye(len(sources), dtype=bool))
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(i), pa.string()), "a": sources[i], "b": sources[j],
                         "value": total[i, j], "seen": np.full(len(i), n, np.int64)})

    done = both(own).unionByName(both(empty)).groupBy("lang", "ta", "tb", "bucket").applyInArrow(
        run, "lang string, a long, b long, value long, seen long")
    return done.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def divergence(documents: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The audit of all (lang, source) groups of ``documents`` (lang, source, text)."""
    docs = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(kept_terms(docs, least), "kept-terms")
    words = materialize(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "lang-terms")
    langs = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")]))
    groups = groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = groups.withColumn("tiles", F.expr(f"(max(idx) over (partition by lang)) div {tile} + 1"))
    # without kept terms nothing is shared, and the value is 0 whatever z
    groups = groups.withColumn("z", F.when(F.col("v") > 0, _share("0L", "total", "greatest(v, 1L)")).otherwise(F.lit(1).cast("long")))
    groups = materialize(groups, "groups")

    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(dealt, ["lang", "source", "salt"])
            .select("lang", "source", "term", "idx", "tiles", "v", "lang_total", _share("n", "total", "v").alias("p")))
    rows = materialize(rows, "shares")

    buckets = max(1, -(-rows.count() // bucket_rows))
    sums = _pair_sums(groups.select("lang", "idx", "z", "tiles"), rows.select("lang", "term", "idx", "p", "tiles"), buckets, tile)
    a = groups.select("lang", F.col("idx").alias("a"), "source", "v", F.col("z").alias("za"))
    b = groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"), F.col("z").alias("zb"))
    both_lack = F.expr("((za - zb) * (za - zb)) div zb")
    pairs = sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("value") + (F.col("v") - F.col("seen")) * both_lack).cast("long").alias("value"))

    shared = rows.join(words, ["lang", "term"]).withColumn("q", _share("lang_n", "lang_total", "v")).where("p > q")
    terms = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
                          F.expr("((p - q) * (p - q)) div q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    best = terms.withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).unionByName(best)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see the module's docstring."""
    return divergence(table(spark, sf_dir, "documents"))
