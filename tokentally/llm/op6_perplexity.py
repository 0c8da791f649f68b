"""Quality rules by n-gram perplexity.

A modified Kneser-Ney model of byte n-grams (order 5, inside words with their
bounds) is counted in Spark for every language over all documents and estimated
in Spark level by level, for every n-gram that any document has.  A document's
figure is its bits per word; documents outside their language's band (median -/+
so many spreads) are rejected.

The model is estimated twice: over all documents, then over those that the
first model finds no more surprising than ``TRIM`` of their language, so that
junk doesn't teach the model that judges it.  All documents are scored by both.

Scale: a task reduces its words to distinct n-grams before the shuffle; the
groups of the estimate are contexts, with at most 256 rows each.  No n-gram is
left out of the model: the tasks hold the ``HELD_GRAMS`` most frequent ones, with
the model's figure of each, and hand on the others of each document, which meet
their figures in a join.  The second model's counts are the first's less those of
the documents beyond the limit, so only these are counted again.

Defined cases: null or empty text -> no words, base_failed, not kept; a null
language is a language of its own; a language whose documents all have fewer
than ``MIN_WORDS`` words has no band (its documents fail the base rule);
equal rows get equal results; empty tables work; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.sources import materialize

ORDER = 5
#: Words below which a document fails the base rule.
MIN_WORDS = 20
#: Least share of a language's n-grams for a place in the two highest orders of a ``Model`` cut to a size (0: no cut).
MIN_SHARE = 0.0
#: Most frequent n-grams, with the model's figures, that all tasks hold; the others are joined.
HELD_GRAMS = 1 << 22
#: Slots of the bitmap that spares documents within the limit the join with those beyond it.
SLOTS = 1 << 22
#: Share of the documents of a language that teach the second model.
TRIM = 0.9
#: Band around the median, in robust spreads (1.4826 times the median deviation), below and above.
BAND = (8.0, 40.0)
#: Distinct n-grams that a task gathers before it hands them on.
HELD = 1 << 20
_UNIFORM = 1 / 257


# ---- n-grams of words -------------------------------------------------------------------------

def grams_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 5-byte n-grams of each word with its bounds, flat, and how many each word has."""
    n = ends - starts
    size = n + ORDER                       # three zeros and a space, the word, a space
    at = np.cumsum(size) - size
    buffer = np.zeros(int(size.sum()), np.int64)
    buffer[at + 3] = 32
    buffer[at + size - 1] = 32
    buffer[textops.ragged(at + 4, n)] = raw[textops.ragged(starts, n)]
    packed = buffer[4:].copy()
    for k in range(1, ORDER):
        packed |= buffer[4 - k:len(buffer) - k] << (8 * k)
    return packed[textops.ragged(at, n + 1)], n + 1


def _distinct_words(raw, off, lang_ids):
    """Per distinct (word, language): first span, language; and per word occurrence its row; and word offsets."""
    starts, ends, word_off = textops.words(raw, off)
    lang = np.repeat(lang_ids, np.diff(word_off))
    key = textops.hash_spans(raw, starts, ends) ^ textops.mix64(lang.astype(np.uint64) + np.uint64(1))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(first)              # spans in text order
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = first[order]
    return starts[first], ends[first], lang[first], place[back], word_off


def bits_per_word(model: "Model", raw, off, langs: list[str | None]) -> np.ndarray:
    """Bits per word of each text (0 for a text without words)."""
    ids = model.lang_ids(langs)
    s, e, lang, back, word_off = _distinct_words(raw, off, ids)
    if len(s) == 0:
        return np.zeros(len(langs))
    grams, n = grams_of(raw, s, e)
    keys, place = np.unique((np.repeat(lang, n).astype(np.int64) << 40) | grams, return_inverse=True)
    logs = model.log2(keys)[place]
    word = np.add.reduceat(logs, np.cumsum(n) - n)
    total = np.concatenate([[0.0], np.cumsum(word[back])])
    words = np.diff(word_off)
    return -np.diff(total[word_off]) / np.maximum(words, 1)


def held_bits(model: "Model", raw, off, langs: list[str | None]):
    """Bits per word of each text by the n-grams that the model holds, and the others: per text, n-grams and counts."""
    ids = model.lang_ids(langs)
    s, e, lang, back, word_off = _distinct_words(raw, off, ids)
    none = np.zeros(0, np.int64)
    if len(s) == 0:
        return np.zeros(len(langs)), np.zeros(len(langs) + 1, np.int64), none, none
    grams, n = grams_of(raw, s, e)
    keys, place = np.unique((np.repeat(lang, n).astype(np.int64) << 40) | grams, return_inverse=True)
    found, value = model.held(keys)
    at = np.cumsum(n) - n
    total = np.concatenate([[0.0], np.cumsum(np.add.reduceat(np.where(found, value.astype(np.float64), 0.0)[place], at)[back])])
    words = np.diff(word_off)
    bits = -np.diff(total[word_off]) / np.maximum(words, 1)
    # the other n-grams of each occurrence of a word, once a text
    other = ~found[place]
    per_word = np.add.reduceat(other.astype(np.int64), at)
    occurs = np.flatnonzero(per_word[back])
    if len(occurs) == 0:
        return bits, np.zeros(len(langs) + 1, np.int64), none, none
    first, many = np.cumsum(per_word) - per_word, per_word[back[occurs]]
    wanted = grams[other][textops.ragged(first[back[occurs]], many)]
    pairs, count = np.unique((np.repeat(textops.segments(words)[occurs], many) << 40) | wanted, return_counts=True)
    return bits, np.searchsorted(pairs >> 40, np.arange(len(langs) + 1)), pairs & ((1 << 40) - 1), count


def _counter():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str | None, int] = {}
        held_keys, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            by_id = list(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([by_id[i] for i in (held_keys >> 40).tolist()], pa.string()),
                 pa.array(held_keys & ((1 << 40) - 1), pa.int64()), pa.array(held_counts, pa.int64())],
                names=["lang", "gram", "n"])

        for batch in textops.chunks(batches, "text"):
            raw, off = textops.utf8(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            ids = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            s, e, lang, back, _ = _distinct_words(raw, off, ids)
            if len(s) == 0:
                continue
            grams, n = grams_of(raw, s, e)
            keys = np.concatenate([held_keys, (np.repeat(lang, n) << 40) | grams])
            weights = np.concatenate([held_counts, np.repeat(np.bincount(back, minlength=len(s)), n)])
            held_keys, place = np.unique(keys, return_inverse=True)
            held_counts = np.bincount(place, weights=weights, minlength=len(held_keys)).astype(np.int64)
            if len(held_keys) > HELD:
                yield out()
                held_keys, held_counts = held_keys[:0], held_counts[:0]
        if len(held_keys):
            yield out()
    return run


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all documents."""
    return (docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(_counter(), "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("c")))


# ---- modified Kneser-Ney ----------------------------------------------------------------------

def _levels(top: DataFrame) -> list[DataFrame]:
    """Tables (lang, gram, c) of orders 1..5: raw counts at the top and for n-grams at a word's start,
    below the number of different bytes before them.  An n-gram with count 0 counts for none."""
    levels = [top]
    for k in range(ORDER - 1, 0, -1):
        above = levels[0]
        tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        begins = F.shiftright(tail, 8 * (k - 1)) == 0
        once = F.when(F.col("c") > 0, F.lit(1)).otherwise(F.lit(0))
        lower = (above.select("lang", tail.alias("gram"), F.when(begins, F.col("c")).otherwise(once).alias("c"))
                 .groupBy("lang", "gram").agg(F.sum("c").alias("c")))
        levels.insert(0, lower)
    return levels


def _discounts(levels: list[DataFrame]) -> DataFrame:
    """(lang, k, d1, d2, d3): one row a language and order, from the counts of counts."""
    out = None
    for k, level in enumerate(levels, 1):
        part = level.groupBy("lang").agg(*[F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}")
                                           for i in (1, 2, 3, 4)]).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))

    def d(i):
        a, b = F.col(f"n{i}"), F.col(f"n{i + 1}")
        return F.greatest(F.lit(0.1), F.least(F.lit(i - 0.05),
                                              F.when(a > 0, i - (i + 1) * y * b / a).otherwise(F.lit(0.5 * i))))
    return out.select("lang", "k", *[d(i).alias(f"d{i}") for i in (1, 2, 3)])


def _orders(top: DataFrame, min_share: float = 0.0) -> Iterator[tuple[int, DataFrame]]:
    """Orders from 1 on, each with (lang, gram, ctx, c, gamma, p, below): interpolated probabilities ``p`` of the n-grams
    and back-off weights ``gamma`` of their contexts.  N-grams with count 0 get what back-off leaves them."""
    top = materialize(top, "grams")
    levels = [top] if ORDER == 1 else [materialize(x, "grams") for x in _levels(top)[:-1]] + [top]
    discounts = materialize(_discounts(levels), "discounts")
    lower = None
    for k, level in enumerate(levels, 1):
        d = discounts.where(F.col("k") == k).select(F.col("lang").alias("l2"), "d1", "d2", "d3")
        w = Window.partitionBy("lang", "ctx")        # at most 256 rows a context
        off = (F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).when(F.col("c") == 1, F.col("d1"))
               .otherwise(F.lit(0.0)))
        seen = F.col("s") > 0
        t = (level.join(F.broadcast(d), F.col("lang").eqNullSafe(F.col("l2"))).drop("l2")
             .withColumn("ctx", F.shiftright("gram", 8)).withColumn("off", off)
             .withColumn("s", F.sum("c").over(w)).withColumn("free", F.sum("off").over(w))
             .withColumn("gamma", F.when(seen, F.col("free") / F.col("s")).otherwise(F.lit(1.0))))
        if lower is None:
            t = t.withColumn("below", F.lit(_UNIFORM))
        else:
            t = (t.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
                 .join(lower, F.col("lang").eqNullSafe(F.col("l3")) & (F.col("tail") == F.col("g3"))))
        own = F.when(seen, (F.col("c") - F.col("off")) / F.col("s")).otherwise(F.lit(0.0))
        t = t.withColumn("p", own + F.col("gamma") * F.col("below"))
        t = materialize(t.select(*level.columns, "ctx", "gamma", "p", "below"), "level")
        value, kept = F.col("p"), t
        if min_share > 0 and k >= ORDER - 1:
            total = t.groupBy("lang").agg((F.sum("c") * min_share).alias("least")).withColumnRenamed("lang", "l4")
            held = F.col("c") >= F.col("least")
            # what the held n-grams of a context leave goes to the others, by the model below
            rest = ((1 - F.sum(F.when(held, F.col("p")).otherwise(0.0)).over(w))
                    / F.greatest(F.lit(1e-9), 1 - F.sum(F.when(held, F.col("below")).otherwise(0.0)).over(w)))
            t = (t.join(F.broadcast(total), F.col("lang").eqNullSafe(F.col("l4")))
                 .withColumn("held", held).withColumn("whole", F.min("held").over(w))
                 .withColumn("gamma", F.when(F.col("whole"), F.col("gamma")).otherwise(F.greatest(F.lit(1e-9), rest))))
            value, kept = F.when(F.col("held"), F.col("p")).otherwise(F.col("gamma") * F.col("below")), t.where("held")
        lower = t.select(F.col("lang").alias("l3"), F.col("gram").alias("g3"), value.alias("below"))
        yield k, kept


def estimate(top: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(lang, k, kind, gram, value): interpolated probabilities of n-grams and back-off weights of contexts."""
    out = None
    for k, kept in _orders(top, min_share):
        rows = (kept.select("lang", F.lit(k).alias("k"), F.lit(0).alias("kind"), "gram", F.col("p").alias("value"))
                .unionByName(kept.select("lang", F.lit(k).alias("k"), F.lit(1).alias("kind"),
                                         F.col("ctx").alias("gram"), F.col("gamma").alias("value")).distinct()))
        out = rows if out is None else out.unionByName(rows)
    return out


def gram_values(top: DataFrame) -> DataFrame:
    """(lang, gram, n, value): the probability of every n-gram of ``top`` (lang, gram, c, n), also where c is 0."""
    *_, (_, t) = _orders(top)
    return t.select("lang", "gram", "n", F.col("p").alias("value"))


@dataclass
class Model:
    """Sorted hash arrays: (language, order, n-gram) -> log2 probability, (language, order, context) -> log2 weight."""
    langs: list
    keys: np.ndarray
    values: np.ndarray
    weight_keys: np.ndarray
    weights: np.ndarray

    @staticmethod
    def hashed(lang: np.ndarray, k: int, gram: np.ndarray) -> np.ndarray:
        packed = (lang.astype(np.uint64) << np.uint64(43)) | (np.uint64(k) << np.uint64(40)) | gram.astype(np.uint64)
        return textops.mix64(packed)

    @staticmethod
    def load(rows: DataFrame) -> "Model":
        """The bounded arrays of the estimate."""
        t = rows.toArrow()
        names = t.column("lang").combine_chunks().dictionary_encode(null_encoding="encode")
        by_code = names.dictionary.to_pylist()
        langs = sorted(by_code, key=lambda x: (x is None, x or ""))
        lang = np.array([langs.index(x) for x in by_code], np.int64)[names.indices.to_numpy()]
        k, kind = t.column("k").to_numpy(), t.column("kind").to_numpy()
        gram, value = t.column("gram").to_numpy(), np.log2(t.column("value").to_numpy()).astype(np.float32)
        packed = (lang.astype(np.uint64) << np.uint64(43)) | (k.astype(np.uint64) << np.uint64(40)) | gram.astype(np.uint64)
        hashes = textops.mix64(packed)
        parts = []
        for which in (0, 1):
            h, v = hashes[kind == which], value[kind == which]
            order = np.argsort(h)
            parts += [h[order], v[order]]
        return Model(langs, *parts)

    def lang_ids(self, langs: list) -> np.ndarray:
        at = {x: i for i, x in enumerate(self.langs)}
        return np.array([at.get(x, len(self.langs)) for x in langs], np.int64)

    @staticmethod
    def _find(keys, values, wanted):
        if len(keys) == 0:
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, values[at]

    def held(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams of the highest order, packed as language << 40 | gram, the arrays hold, and their log2."""
        return self._find(self.keys, self.values, self.hashed(packed >> 40, ORDER, packed & ((1 << 40) - 1)))

    def log2(self, packed: np.ndarray) -> np.ndarray:
        """log2 probability of n-grams packed as language << 40 | gram, backing off where they are not held."""
        lang, gram = packed >> 40, packed & ((1 << 40) - 1)
        out = np.zeros(len(packed))
        todo = np.arange(len(packed))
        for k in range(ORDER, 0, -1):
            g = gram[todo] & ((1 << (8 * k)) - 1)
            found, value = self._find(self.keys, self.values, self.hashed(lang[todo], k, g))
            out[todo[found]] += value[found]
            todo, g = todo[~found], g[~found]
            held, weight = self._find(self.weight_keys, self.weights, self.hashed(lang[todo], k, g >> 8))
            out[todo[held]] += weight[held]
        out[todo] += np.log2(_UNIFORM)
        return out


# ---- base rules -------------------------------------------------------------------------------

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW_WORDS = 8


def base_counts(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, word_off = textops.words(raw, off)
    n_words = np.diff(word_off)

    def per_text(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])

    chars = per_text(~textops.SPACE[raw] & ((raw & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[raw])
    # lines with a word: all but the first of each kind in a text
    dup = np.zeros(n, np.int64)
    if len(starts):
        cuts = np.unique(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1]))
        stops = np.append(cuts[1:], len(raw))
        stops = np.where((stops > cuts) & (raw[np.maximum(stops - 1, 0)] == 10), stops - 1, stops)
        solid = np.searchsorted(starts, cuts) < np.searchsorted(starts, stops)
        ls, le = cuts[solid], stops[solid]
        doc = np.searchsorted(off, ls, "right") - 1
        key = textops.hash_spans(raw, ls, le) ^ textops.mix64(doc.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(key, return_index=True)
        dup = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW_WORDS:
        h = textops.hash_spans(raw, starts, ends)
        m = len(h) - WINDOW_WORDS + 1
        w = np.zeros(m, np.uint64)
        for i in range(WINDOW_WORDS):
            w = w * np.uint64(0x100000001B3) + h[i:i + m]
        doc = textops.segments(n_words)
        at = np.flatnonzero(doc[:m] == doc[WINDOW_WORDS - 1:])
        key = textops.mix64(w[at]) ^ textops.mix64(doc[at].astype(np.uint64) + np.uint64(1))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[back] >= 2]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW_WORDS, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        repeat = np.diff(covered[word_off])
    return [n_words, chars, symbols, dup, repeat]


# ---- the operator -----------------------------------------------------------------------------

def _bits_column(model_of, base: bool):
    """Bits per word by the held n-grams, the other n-grams (and the base counts) of whole texts; the text goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in textops.chunks(batches, "text"):
            raw, off = textops.utf8(batch.column("text"))
            bits, cuts, grams, n = held_bits(model, raw, off, batch.column("lang").to_pylist())
            counts = base_counts(raw, off) if base else [np.diff(textops.words(raw, off)[2])]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"][:len(counts)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(bits, pa.float64())]
                + [textops.list_array(x, cuts, pa.int64()) for x in (grams, n)],
                names=[*keep, *names, "bits", "grams", "times"])
    return run


def scored(docs: DataFrame, values: DataFrame, base: bool) -> DataFrame:
    """The columns of ``docs`` but the text, ``n_words`` (with ``base``: all counts) and ``bits`` per word of each row.

    ``values`` (lang, gram, n, value; written) has every n-gram of the documents: the most frequent ones go to the
    tasks, the others come to the rows that have them.
    """
    spark = docs.sparkSession
    size, rest = values.count(), None
    held = values
    if size > HELD_GRAMS:
        least = values.agg(F.percentile_approx("n", F.lit(1 - HELD_GRAMS / size), F.lit(100_000))).first()[0]
        held, rest = values.where(F.col("n") > least), values.where(F.col("n") <= least)
    rows = held.select("lang", F.lit(ORDER).alias("k"), F.lit(0).alias("kind"), "gram", "value")
    model = spark.sparkContext.broadcast(Model.load(rows))
    docs = docs.withColumn("uid", F.monotonically_increasing_id())
    kept = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"][:5 if base else 1]
    schema = ", ".join([f"{c} {kinds[c]}" for c in kept] + [f"{c} long" for c in counts]
                       + ["bits double, grams array<long>, times array<long>"])
    rows = materialize(docs.mapInArrow(_bits_column(lambda: model.value, base), schema), "perplexity")
    out = rows.drop("grams", "times")
    if rest is not None:
        wanted = (rows.select("uid", F.col("lang").alias("l2"), F.explode(F.arrays_zip("grams", "times")).alias("x"))
                  .select("uid", "l2", F.col("x.grams").alias("g2"), F.col("x.times").alias("times")))
        found = wanted.join(rest, F.col("l2").eqNullSafe(F.col("lang")) & (F.col("g2") == F.col("gram")))
        more = found.groupBy("uid").agg(F.sum(F.col("times") * F.log2("value")).alias("more"))
        bits = F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.col("bits") - F.col("more") / F.col("n_words"))
        out = materialize(out.join(more, "uid", "left").withColumn("bits", bits).drop("more"), "perplexity")
    return out.drop("uid")


def _surprising(docs: DataFrame, beyond: DataFrame) -> DataFrame:
    """The rows of ``docs`` (lang, th, text) whose (lang, th) is in ``beyond``; the others are not shuffled."""
    slot = F.pmod("th", F.lit(SLOTS))
    marks = (beyond.groupBy(F.floor(slot / 64).alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(th, {SLOTS}) % 64 as int))")).alias("marks")))
    near = (docs.join(F.broadcast(marks), F.floor(slot / 64) == F.col("word"))
            .where(F.expr(f"(shiftright(marks, cast(pmod(th, {SLOTS}) % 64 as int)) & 1) = 1")))
    b = beyond.select(F.col("lang").alias("l2"), F.col("th").alias("t2"))
    return near.join(b, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("th") == F.col("t2")), "left_semi")


def perplexity_rules(docs: DataFrame, trim: float = TRIM, band: tuple[float, float] = BAND) -> DataFrame:
    """One row a document: the base counts, bits per word, the language's band and the verdict."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    grams = materialize(count_grams(docs).withColumn("n", F.col("c")), "grams")
    hashed = docs.select("lang", F.xxhash64("text").alias("th"), "text")
    by_first = scored(hashed, materialize(gram_values(grams), "values"), False)
    # one row a language
    tops = (by_first.where(F.col("n_words") >= MIN_WORDS).groupBy(F.col("lang").alias("l2"))
            .agg(F.percentile_approx("bits", F.lit(trim), F.lit(1000)).alias("top")))
    beyond = materialize(by_first.join(F.broadcast(tops), F.col("lang").eqNullSafe(F.col("l2")))
                         .where(F.col("bits") > F.col("top")).select("lang", "th").distinct(), "beyond")
    less = count_grams(_surprising(hashed, beyond)).select(F.col("lang").alias("l2"), F.col("gram").alias("g2"),
                                                           F.col("c").alias("less"))
    taught = (grams.join(less, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("gram") == F.col("g2")), "left")
              .select("lang", "gram", (F.col("c") - F.coalesce("less", F.lit(0))).alias("c"), "n"))
    rows = scored(docs, materialize(gram_values(taught), "values"), True)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    judged = rows.where(~F.col("base_failed"))
    middle = judged.groupBy("lang").agg(F.percentile_approx("bits", F.lit(0.5), F.lit(2000)).alias("mid"))
    spread = (judged.join(F.broadcast(middle.withColumnRenamed("lang", "l2")), F.col("lang").eqNullSafe(F.col("l2")))
              .groupBy("lang", "mid")
              .agg((1.4826 * F.percentile_approx(F.abs(F.col("bits") - F.col("mid")), F.lit(0.5), F.lit(2000))).alias("mad")))
    bands = spread.select(F.col("lang").alias("l3"), (F.col("mid") - band[0] * F.col("mad")).alias("low"),
                          (F.col("mid") + band[1] * F.col("mad")).alias("high"))
    return (rows.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("l3")), "left").drop("l3")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")),
                                                                   F.lit(True))))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    rows = perplexity_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "lang", F.col("bits").alias("bits_per_word"), "low", "high")
