"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised on their bytes (A-Z lower-cased, every
run of white space and ASCII punctuation one space).  An item of m bytes with an
edit budget of k = floor(``rate`` * m) shares at least m - q + 1 - k*q of its
q-grams with any text region that it matches, all within a diagonal band of
width k.  Per document:

1. every q-gram is looked up in a bitmap of the items' q-grams; aligned windows
   with fewer hits than the lemma leaves to the fullest window of a match are out;
2. hits in and around the other windows are expanded to (item, diagonal), at
   most ``SLICE`` at a time, and counted in bands of width 2(k+1) that overlap
   by half;
3. bands that meet the item's bound are verified by banded alignment of the
   whole item against the region (free ends in the text, at most k edits).  A
   bit-parallel search of the region, first of all touching bands together and
   then of each, leaves out those that hold no match, so a line that many items
   share costs one pass over its places and no alignment.

No shuffle: documents are mapped against the stated benchmark in blocks of at
most ``BLOCK_BYTES`` of item text, so what a task holds is bounded; a larger
benchmark takes more passes over the chunk, not more memory.

Defined cases: null or empty text -> no match; items that are null or shorter
than q after normalising match nothing; repeated items are reported each, items
without an id with a null id (last among matches of one start, last in
``item_ids``); an empty benchmark or table works; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.sources import append

Q = 9
#: Edits allowed, as a share of the item's normalised bytes.
RATE = 0.06
#: Item text of a benchmark block (what one pass keeps in a task).
BLOCK_BYTES = 4 << 20
#: Aligned windows for the first test.
WINDOW = 64
#: Pairs of a text place and an item place that are held at once.
SLICE = 1 << 20
#: Pairs of places from which on a repeated q-gram is counted by intervals.
RUN_PAIRS = 1 << 14
#: Cells of a slice's table of counts (items by bands).
TABLE = 1 << 22
#: Places hashed at once.
BLOCK = 1 << 15
_BITS = 21

MATCHES = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("edits", pa.int32())]))

def qgrams(b: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q bytes from each place (len - q + 1 of them)."""
    out = np.zeros(max(len(b) - q + 1, 0), np.uint64)
    for i in range(0, len(out), BLOCK):     # small blocks stay in the processor's cache
        power, size, base = b[i:i + BLOCK + q - 1].astype(np.uint64), 1, 0x100000001B3
        h, length = None, 0                 # hash of the first `length` bytes
        while size <= q:
            if q & size:
                h = power if h is None else h[:len(power) - length] * np.uint64(
                    pow(base, size, 1 << 64)) + power[length:]
                length += size
            nxt = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:] if len(power) > size else power[:0]
            power, size = nxt, 2 * size
        out[i:i + BLOCK] = (h * np.uint64(0x9E3779B97F4A7C15))[:len(out) - i]
    return out


@dataclass
class Index:
    """The q-grams of a block of items, sorted, with their item and place."""
    ids: list[int | None]
    texts: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    least: int
    reach: int


def build_index(items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Index | None:
    ids, texts, keys, owner, place = [], [], [], [], []
    for item_id, text in items:
        raw, off = textops.utf8(pa.array([text], pa.large_string()))
        b = textops.normalise(raw, off)[0]
        b = b[:-1] if len(b) and b[-1] == 32 else b
        if len(b) < q:
            continue
        g = qgrams(b, q)
        keys.append(g)
        owner.append(np.full(len(g), len(ids), np.int32))
        place.append(np.arange(len(g), dtype=np.int32))
        ids.append(item_id)
        texts.append(b.tobytes())
    if not ids:
        return None
    m = np.array([len(t) for t in texts])
    # the lemma must leave at least one shared q-gram
    budget = np.minimum(np.floor(rate * m).astype(np.int64), (m - q) // q)
    bound = m - q + 1 - budget * q
    spans = -(-(m + budget) // WINDOW) + 1
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[keys >> np.uint64(64 - _BITS)] = True
    return Index(ids, texts, budget, bound, keys, np.concatenate(owner)[order],
                 np.concatenate(place)[order], bitmap, int(np.min(-(-bound // spans))), int(np.max(m + 2 * budget)))


def align(item: np.ndarray, region: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Least edits of the whole item within the region, on diagonals low..high (region place - item place).

    Returns (edits, start, end) in the region or None beyond the budget.  Free ends in the region.
    """
    low, high = low - budget, high + budget
    width = high - low + 1
    far = 1 << 28
    step = np.arange(width)
    cols = low + step                      # region place of the band at item place 0
    cost = np.where((cols >= 0) & (cols <= len(region)), 0, far)
    start = cols.copy()
    for i, c in enumerate(item):
        j = i + cols                       # the region byte that a match would use
        ok = (j >= 0) & (j < len(region))
        same = np.zeros(width, bool)
        same[ok] = region[j[ok]] == c
        diagonal = np.where(ok, cost + ~same, far)
        skip = np.append(cost[1:] + 1, far)                      # item byte without partner
        up = np.append(start[1:], 0)
        best = np.where(diagonal <= skip, diagonal, skip)
        origin = np.where(diagonal <= skip, start, up)
        # region bytes without partner: cheapest earlier place plus the distance
        run = np.minimum.accumulate(best - step)
        source = np.maximum.accumulate(np.where(best - step == run, step, 0))
        place = j + 1
        cost = np.where((place >= 0) & (place <= len(region)), run + step, far)
        start = origin[source]
        if cost.min() > budget:
            return None
    at = int(np.argmin(cost))
    if cost[at] > budget:
        return None
    return int(cost[at]), int(start[at]), int(len(item) + cols[at])


def _search(index: Index, b: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of the matches in normal bytes."""
    g = qgrams(b)
    if len(g) == 0:
        return
    hit = index.bitmap[g >> np.uint64(64 - _BITS)]
    n = -(-len(g) // WINDOW)
    per = np.add.reduceat(hit, np.arange(0, len(g), WINDOW), dtype=np.int64)
    full = np.flatnonzero(per >= index.least)
    if len(full) == 0:
        return
    reach = -(-index.reach // WINDOW) + 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(full - reach, 0), 1)
    np.add.at(edge, np.minimum(full + reach + 1, n), -1)
    near = np.flatnonzero(hit & np.repeat(np.cumsum(edge[:-1]) > 0, WINDOW)[:len(g)])
    doc, item, band, count = _counts(index, g, off, near)
    if len(doc) == 0:
        return
    full = count >= index.bound[item]
    doc, item, band = doc[full], item[full], band[full]
    last: dict[tuple[int, int], int] = {}
    group = np.cumsum(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(band) > 1)][:len(doc)])
    ends = np.searchsorted(group, group, "right")
    hopeless = 0
    for i in range(len(doc)):
        d, x, k = int(doc[i]), int(item[i]), int(index.budget[item[i]])
        text, size = index.texts[x], len(index.texts[x])

        def span(n: int) -> tuple[int, int]:
            first = int(band[n]) * (k + 1)
            return max(int(off[d]), first - k), min(int(off[d + 1]), first + 2 * (k + 1) + size + k)
        if group[i] == hopeless:
            continue
        lo_, hi_ = span(i)
        if (i == 0 or group[i] != group[i - 1]) and not holds(text, b[lo_:span(ends[i] - 1)[1]].tobytes(), k):
            hopeless = group[i]
            continue
        if last.get((d, x), -1) >= lo_ + size // 2:
            continue                        # the neighbouring band found this place
        region, first = b[lo_:hi_], int(band[i]) * (k + 1)
        exact = region.tobytes().find(text)
        found = ((0, exact, exact + size) if exact >= 0 else
                 align(np.frombuffer(text, np.uint8), region, k, first - lo_, first - lo_ + 2 * (k + 1))
                 if ends[i] - i == 1 and group[i] != group[i - 1] or holds(text, region.tobytes(), k) else None)
        if found:
            last[(d, x)] = lo_ + found[2]
            yield d, x, lo_ + found[1], lo_ + found[2], found[0]


def _counts(index: Index, g: np.ndarray, off: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, band, shared q-grams), in that order, of the text places ``near``.

    The pairs of places are counted in slices, so a text and items that repeat q-grams take no more memory.  A
    q-gram that a text repeats place after place meets an item place on consecutive diagonals, which are counted
    as one interval."""
    doc = np.searchsorted(off, near, "right") - 1
    inside = near + Q <= off[doc + 1]
    near, doc = near[inside], doc[inside]
    lo = np.searchsorted(index.keys, g[near], "left")
    n = np.searchsorted(index.keys, g[near], "right") - lo
    parts: list[np.ndarray] = []
    if len(near):
        first = np.flatnonzero(np.r_[True, (np.diff(near) != 1) | (g[near[1:]] != g[near[:-1]]) | (np.diff(doc) != 0)])
        length = np.diff(np.append(first, len(near)))
        long = (length > 1) & (length * n[first] >= RUN_PAIRS)
        for f, r in zip(first[long].tolist(), length[long].tolist()):
            parts.append(_interval_counts(index, int(doc[f]), int(near[f]), r, int(lo[f]), int(n[f])))
        rest = ~np.repeat(long, length)
        near, doc, lo, n = near[rest], doc[rest], lo[rest], n[rest]
    total = np.cumsum(n)
    a = 0
    while a < len(near):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, "right")))
        got = textops.ragged(lo[a:z], n[a:z])
        item = index.item[got].astype(np.int64)
        half = index.budget[item] + 1
        band = (np.repeat(near[a:z], n[a:z]) - index.place[got]) // half
        owner = np.repeat(doc[a:z], n[a:z])
        a = z
        if len(got) == 0:
            continue
        # each hit counts in its band and in the one that begins half a band earlier
        d0, i0, b0 = int(owner[0]), int(item.min()), int(band.min()) - 1
        docs, items, bands = int(owner[-1]) - d0 + 1, int(item.max()) - i0 + 1, int(band.max()) - b0 + 1
        key = ((owner - d0) * items + (item - i0)) * bands + (band - b0)
        if docs * items * bands <= TABLE:
            table = np.bincount(key, minlength=docs * items * bands)
            cells = table + np.append(table[1:], 0)          # a table row begins with a band that no hit is in
            key = np.flatnonzero(cells)
            cells = cells[key]
        else:
            key, cells = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        parts.append(np.stack([key // (items * bands) + d0, key // bands % items + i0, key % bands + b0, cells]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    doc, item, band, cells = np.concatenate(parts, axis=1)
    order = np.lexsort((band, item, doc))
    doc, item, band, cells = doc[order], item[order], band[order], cells[order]
    new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (band[1:] != band[:-1])])
    return doc[new], item[new], band[new], np.add.reduceat(cells, new)


def _interval_counts(index: Index, doc: int, place: int, length: int, lo: int, n: int) -> np.ndarray:
    """``_counts`` of one q-gram at ``length`` text places from ``place`` on, with its ``n`` item places."""
    items, places = index.item[lo:lo + n], index.place[lo:lo + n]
    out = []
    for x in np.unique(items).tolist():
        own = places[items == x]
        half = int(index.budget[x]) + 1
        low = (place - int(own.max())) // half * half - half     # from the start of a band that no hit is in
        width = place + length - int(own.min()) - low
        steps = np.zeros(-(-width // half) * half + half, np.int64)
        np.add.at(steps, place - own - low, 1)
        np.add.at(steps, place + length - own - low, -1)
        table = np.cumsum(steps).reshape(-1, half).sum(axis=1)
        cells = table + np.append(table[1:], 0)
        at = np.flatnonzero(cells)
        out.append(np.stack([np.full(len(at), doc), np.full(len(at), x), at + low // half, cells[at]]))
    return np.concatenate(out, axis=1)


def holds(item: bytes, region: bytes, budget: int) -> bool:
    """Whether any part of the region is within ``budget`` edits of the item (one bit a byte of the item)."""
    m = len(item)
    if budget >= m:
        return True
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, cost = every, 0, m         # vertical steps of the cost column
    for c in region:
        x = masks.get(c, 0) | minus
        diagonal = ((plus + (x & plus)) ^ plus) | x
        up, down = minus | (every & ~(plus | diagonal)), plus & diagonal
        if up & top:
            cost += 1
        elif down & top:
            cost -= 1
            if cost <= budget:
                return True
        up <<= 1
        minus = up & diagonal & every
        plus = ((down << 1) | ~(up | diagonal)) & every
    return False


def _finder(blocks: list[Index]):
    def make():
        def compute(raw: np.ndarray, off: np.ndarray):
            out: list[list] = [[] for _ in range(len(off) - 1)]
            if blocks:
                b, boff, at = textops.normalise(raw, off)
                chars = None
                for index in blocks:
                    for d, x, lo, hi, edits in _search(index, b, boff):
                        if chars is None:   # code points before each byte
                            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        s, e = int(at[lo]), int(at[hi - 1]) + 1
                        out[d].append({"item_id": index.ids[x], "start": int(chars[s] - chars[off[d]]),
                                       "end": int(chars[e] - chars[off[d]]), "edits": edits})
            return [pa.array([sorted(m, key=lambda r: (r["start"], r["item_id"] is None, r["item_id"] or 0)) for m in out], _MATCH_TYPE)]
        return compute
    return make


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded text, read one partition at a time."""
    block, size = [], 0
    rows = (benchmark.where("text is not null")
            .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
    for r in rows.toLocalIterator():
        if block and size + len(r["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches", keep: list[str] | None = None,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with an array column of the benchmark items found in each text and where (code points)."""
    out, passes = docs, 0
    kept = list(keep if keep is not None else docs.columns)
    for block in benchmark_blocks(benchmark, block_bytes):
        index = build_index(block)
        if index is None:
            continue
        field = f"{name}_{passes}"
        out = append(out, {field: MATCHES}, _finder([index]),
                     keep=list(dict.fromkeys([*kept, "text", *[f"{name}_{i}" for i in range(passes)]])))
        passes += 1
    parts = [F.col(f"{name}_{i}") for i in range(passes)]
    all_ = F.concat(*parts) if parts else F.expr(f"cast(array() as {MATCHES})")
    return out.select(*[F.col(f"`{c}`") for c in kept if c != name], all_.alias(name))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"),
                        F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), "matches")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without benchmark passages."""
    name = "benchmark_matches"
    while name in docs.columns:
        name = "_" + name
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    return found.where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
