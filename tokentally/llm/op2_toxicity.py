"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
the windows that set toxic text apart (words whose distinct contexts lie
significantly in toxic documents; counting contexts, not copies, keeps copied
documents from teaching their own vocabulary).  Every window of a text, one word
written ``REPEAT`` times so that zstandard always codes it, is compressed with
both; the gap in bytes says how much better the toxic dictionary knows it.  A
document's evidence are its numbers of windows at each gap, and a logistic
model calibrated on labelled documents turns them into a score.

The classifier is fitted on at most ``SAMPLE`` labelled documents a class (the
documented bound, chosen by a hash of the id) that are weighted by the true
numbers of both classes, so the 0.5 cut means the same above and below the
bound; every document's whole text is scored.  Windows are compressed once per distinct word and worker, in a bounded cache.

Defined cases: null or empty text has no windows and gets the score of no
evidence; null ids and ids without label never teach; conflicting labels of an
id count as toxic; without toxic labels every score is 0; repeated rows are
scored alike; empty tables work; other columns pass through the stage.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.sources import append

#: Most labelled documents of a class that the classifier is fitted on.
SAMPLE = 3000
#: Copies of a word in its window.
REPEAT = 4
#: Windows of ordinary text (words each, and how many) for its dictionary.
ORDINARY_WORDS, ORDINARY_WINDOWS = 8, 100_000
#: (d, k) of the toxic dictionaries that are trained; the one that separates the fitted documents best is kept.
COVERS = ((0, 0), (6, 16), (6, 24), (6, 32), (8, 24), (8, 32), (6, 48))
#: Most bytes of the two dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 4 << 10
#: Words set toxic text apart from this log-likelihood ratio and this ratio of rates on.
LEAST_G2, LEAST_RATIO = 15.0, 20.0
#: Gaps of MAX_GAP bytes and more count alike.
MAX_GAP = 6
#: Level of the compressor; dictionaries are digested once.
LEVEL = 19
#: Words kept with their gap per Python worker.
CACHE_WORDS = 2_000_000


def _compressor(dictionary: bytes, raw: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    p = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False,
        write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Model:
    """Dictionaries (bytes, and whether they are raw content) and the calibrated weights."""
    ordinary: bytes
    ordinary_raw: bool
    toxic: bytes
    toxic_raw: bool
    weights: np.ndarray

    @property
    def key(self) -> str:
        return hashlib.sha256(self.ordinary + self.toxic).hexdigest()


class Gaps:
    """Gap of words under a model, each compressed once."""

    def __init__(self, model: Model):
        self.key = model.key
        self.blank = not model.toxic
        if not self.blank:
            self.ordinary = _compressor(model.ordinary, model.ordinary_raw)
            self.toxic = _compressor(model.toxic, model.toxic_raw)
        self.keys, self.gaps = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def gap(self, word: bytes) -> int:
        window = (b" " + word) * REPEAT
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window))

    def of(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Gap of every word occurrence, cut to 0..MAX_GAP."""
        if self.blank:
            return np.zeros(len(hashes), np.int64)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        have = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~have)
        if len(new):
            if len(self.keys) + len(new) > CACHE_WORDS:
                self.keys, self.gaps = self.keys[:0], self.gaps[:0]
                new = np.arange(len(keys))
            got = np.fromiter((min(MAX_GAP, max(0, self.gap(raw[starts[i]:ends[i]].tobytes()))) for i in first[new]),
                              np.int8, len(new))
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.gaps = merged[order], np.concatenate([self.gaps, got])[order]
            at = np.searchsorted(self.keys, keys)
        return self.gaps[at].astype(np.int64)[back]


_HELD: list[Gaps] = []


def gaps_of(model: Model) -> Gaps:
    """The worker's cache for this model (the last model's only)."""
    if not _HELD or _HELD[0].key != model.key:
        _HELD[:] = [Gaps(model)]
    return _HELD[0]


def _words(raw: np.ndarray, off: np.ndarray):
    """Words (letters and digits, A-Z lower-cased) with their hashes, and word offsets of the texts."""
    b, boff, _ = textops.normalise(raw, off)
    starts, ends, word_off = textops.words(b, boff)
    return b, starts, ends, word_off, textops.hash_spans(b, starts, ends)


def evidence(gaps: Gaps, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text: 1, log counts of its windows at gaps 1..MAX_GAP, and log of its words."""
    b, starts, ends, word_off, h = _words(raw, off)
    n = len(off) - 1
    words = np.diff(word_off)
    cell = textops.segments(words) * (MAX_GAP + 1) + gaps.of(h, b, starts, ends)
    counts = np.bincount(cell, minlength=n * (MAX_GAP + 1)).reshape(n, MAX_GAP + 1)
    return np.column_stack([np.ones(n), np.log1p(counts[:, 1:]), np.log1p(words)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic model by Newton steps; ``weight`` counts each row so many times."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(size: int, samples: list[bytes], d: int = 0, k: int = 0) -> tuple[bytes, bool]:
    """A trained dictionary, or its samples as raw content if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, d=d, k=k).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:], True


def _contexts(texts: pa.Array, windows: int | None, rng):
    """Words of the texts (hashes, sorted), their numbers of distinct contexts, and the sum of these;
    then the spelling of each word, or (with ``windows``) samples of the texts' windows."""
    words, contexts, spelled, plain = [], [], {}, []
    for batch in textops.chunks([pa.record_batch({"t": texts})], "t"):
        b, starts, ends, word_off, h = _words(*textops.utf8(batch.column("t")))
        if len(h) == 0:
            continue
        doc = textops.segments(np.diff(word_off))
        same = np.append(doc[1:] == doc[:-1], False)
        after = np.where(same, np.append(h[1:], np.uint64(0)), np.uint64(0))
        before = np.where(np.append(False, same[:-1]), np.append(np.uint64(0), h[:-1]), np.uint64(0))
        context, first = np.unique(textops.mix64(h + before * np.uint64(3)) + after * np.uint64(5), return_index=True)
        words.append(h[first])
        contexts.append(context)
        if windows is None:
            key, at = np.unique(h, return_index=True)
            spelled.update((k, b[starts[i]:ends[i]].tobytes()) for k, i in zip(key.tolist(), at.tolist()) if k not in spelled)
        else:
            at = np.arange(0, len(h), ORDINARY_WORDS)
            take = max(1, ORDINARY_WINDOWS * batch.num_rows // windows)
            at = at[rng.permutation(len(at))[:take]]
            stop = np.minimum(at + ORDINARY_WORDS, len(h)) - 1
            plain += [b" " + b[starts[i]:ends[j]].tobytes() for i, j in zip(at, stop)]
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], []
    _, first = np.unique(np.concatenate(contexts), return_index=True)
    keys, counts = np.unique(np.concatenate(words)[first], return_counts=True)
    return keys, counts, len(first), [spelled[k] for k in keys.tolist()] if windows is None else [], plain


def class_weights(sampled: tuple[int, int], known: tuple[int, int]) -> tuple[float, float]:
    """Weights of the sampled toxic and ordinary documents: the classes' true shares, as many documents in all."""
    (a, b), (ka, kb) = sampled, known
    return (a + b) * ka / (ka + kb) / a, (a + b) * kb / (ka + kb) / b


def fit(toxic: pa.Array, ordinary: pa.Array, known: tuple[int, int] | None = None) -> Model:
    """Dictionaries and calibration from labelled texts; ``known`` are the true numbers of both classes."""
    blank = Model(b"", True, b"", True, np.array([-30.0] + [0.0] * (MAX_GAP + 1)))
    if not toxic or not ordinary:
        return blank
    rng = np.random.default_rng(7)
    tk, tc, nt, spelled, _ = _contexts(toxic, None, rng)
    ok, oc, no, _, plain = _contexts(ordinary, max(1, len(ordinary)), rng)
    if nt == 0 or no == 0:
        return blank
    at = np.minimum(np.searchsorted(ok, tk), len(ok) - 1)
    co = np.where(ok[at] == tk, oc[at], 0)
    share = nt / (nt + no)
    total = tc + co
    g2 = 2 * (tc * np.log(tc / (total * share)) + co * np.log(np.maximum(co, 1) / (total * (1 - share))))
    apart = (g2 >= LEAST_G2) & (tc / nt >= LEAST_RATIO * (co + 0.5) / no)
    samples = [b" " + spelled[i] + b" " for i in np.flatnonzero(apart).tolist() for _ in range(min(int(tc[i]), 200))]
    samples = [samples[i] for i in rng.permutation(len(samples))]
    if not samples:
        return blank
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    sampled = (len(toxic), len(ordinary))
    weight = np.where(y == 1, *class_weights(sampled, known or sampled))
    ordinary_dictionary = _dictionary(ORDINARY_BYTES, plain)
    keys, spelled = _spelled(pa.chunked_array([toxic, ordinary]))
    lengths = _lengths(ordinary_dictionary, spelled)
    best = None
    for d, k in COVERS:
        model = Model(*ordinary_dictionary, *_dictionary(TOXIC_BYTES, samples, d, k), np.zeros(MAX_GAP + 2))
        gaps = Gaps(model)
        gaps.keys = keys
        gaps.gaps = np.clip(lengths - _lengths((model.toxic, model.toxic_raw), spelled), 0, MAX_GAP).astype(np.int8)
        x = np.concatenate([evidence(gaps, *textops.utf8(batch.column("t"))) for texts in (toxic, ordinary)
                            for batch in textops.chunks([pa.record_batch({"t": texts})], "t")])
        model.weights = logistic(x, y, weight)
        loss = float((weight * np.logaddexp(0, -(2 * y - 1) * (x @ model.weights))).sum())
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def _spelled(texts: pa.ChunkedArray) -> tuple[np.ndarray, list[bytes]]:
    """Distinct words of the texts: sorted hashes and spellings."""
    out: dict[int, bytes] = {}
    for chunk in texts.chunks:
        for batch in textops.chunks([pa.record_batch({"t": chunk})], "t"):
            b, starts, ends, _, h = _words(*textops.utf8(batch.column("t")))
            key, at = np.unique(h, return_index=True)
            out.update((k, b[starts[i]:ends[i]].tobytes()) for k, i in zip(key.tolist(), at.tolist()) if k not in out)
    keys = np.array(sorted(out), np.uint64)
    return keys, [out[k] for k in keys.tolist()]


def _lengths(dictionary: tuple[bytes, bool], words: list[bytes]) -> np.ndarray:
    """Compressed length of each word's window."""
    compress = _compressor(*dictionary).compress
    return np.fromiter((len(compress((b" " + w) * REPEAT)) for w in words), np.int64, len(words))


def held_out(doc_id):
    """True where crc32 of the id as text leaves 0 by 5 (null ids too: they never teach)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents outside the held-out fold, at most ``sample`` of each class, at their true shares."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)")
             .select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
             .join(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("label_id")).distinct(),
                   "label_id", "left_semi"))
    numbers = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    order = F.xxhash64(F.lit(11), "label_id")
    chosen = (known.where("toxic = 1").orderBy(order).limit(sample)
              .unionByName(known.where("toxic = 0").orderBy(order).limit(sample)))
    # at most 2 * sample ids; a repeated id gives one text
    rows = (docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text"))
            .where("text is not null").join(F.broadcast(chosen), "label_id")
            .groupBy("label_id", "toxic").agg(F.min("text").alias("text")).orderBy("label_id").toArrow())
    texts, toxic = rows.column("text").combine_chunks(), rows.column("toxic").to_numpy()
    return fit(texts.filter(pa.array(toxic == 1)), texts.filter(pa.array(toxic == 0)), (numbers[0], numbers[1]))


def score_texts(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the toxicity score of each whole text."""
    def make():
        gaps = gaps_of(model)

        def compute(raw: np.ndarray, off: np.ndarray):
            return [pa.array(1 / (1 + np.exp(-np.clip(evidence(gaps, raw, off) @ model.weights, -30, 30))), pa.float64())]
        return compute
    return append(docs, {name: "double"}, make, keep=keep)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (score_texts(docs, model, keep=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not rejected as toxic."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity_score"
    while name in docs.columns:
        name = "_" + name
    return score_texts(docs, model, name).where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
