"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles (64-bit hashes).  The result is exact: every
pair of sets with Jaccard similarity >= ``num / den`` ends in one component.

1. Equal sets are one node (digest); copies never meet in pairs.
2. Prefix rule: two sets that link share at least l tokens among the first
   n - ceil(t n) + l of each in any common order (l: 1 and ``EXTRA`` percent of the
   size).  A set with fewer shared tokens in its prefix links with nothing and is
   done.  Tokens that are frequent in a sample of documents go last in the order,
   so shared lines and passages don't bring unlike documents together; the order
   changes the work, not the result.
3. First pass: nodes meet under their first shared prefix token, in blocks of
   ``BLOCK`` nodes (large groups are dealt into blocks in several ways).  A
   signature tree over a block (leaves: token bitmap and size; above: OR-combined
   bitmaps and size ranges) is joined with itself by dual traversal: a pair of
   tree nodes is left out if its largest possible overlap is too small or all of
   its documents are already linked.  Leaf pairs are verified on the tokens.
4. Second pass, for what the first missed: only tokens that still join two
   different components, one of those with the same nodes.  Their nodes meet in
   pairs of blocks, with bitmaps alone; a meeting hands on the nodes of components
   that the bitmaps allow to link, once each, not their pairs.  Equal sets of such
   nodes are one, and are joined like the blocks of the first pass, on the tokens.
5. Components of all verified links (``components``).

No group is gathered in one task beyond a block (or a pair of blocks), no
all-pairs output is made, and no candidate is capped.  What goes to all tasks is
the list of frequent tokens, at most ``FREQUENT_MAX`` numbers.

Defined cases: null or empty text (or only white space) -> 0 shingles, linked
with nothing; fewer than k words -> the whole sequence is the one shingle; null
doc_id rows link like others but don't name a component; repeated rows share
their component; empty tables work; other columns pass through the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.llm.components import components
from tokentally.llm.sources import materialize

#: Nodes of a block (what a task joins with itself or with one other block).
BLOCK = 512
#: Ways in which a group beyond a block is dealt into blocks in the first pass.
DEALS = 3
#: Percent of a set's size by which its prefix, and the tokens it must share there, grow.
EXTRA = 3
#: Slots of the bitmap that spares documents without partners the second reading (a fixed size).
SLOTS = 1 << 22
#: Documents of the sample that finds frequent tokens, least count there, and most tokens kept.
SAMPLE_DOCS, SAMPLE_LEAST, FREQUENT_MAX = 20_000, 4, 1_000_000
#: Children of a signature tree node.
FANOUT = 8
#: Bits of a bitmap for each token (rounded up to a power of two).
BITS_PER_TOKEN = 3


@dataclass(frozen=True)
class Rule:
    """k-word shingles; sets link from num/den similarity on."""
    k: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, n: int) -> int:
        """Length of the prefix in which sets that link share ``1 + EXTRA * size // 100`` tokens."""
        return n - -(-self.num * n // self.den) + 1 + EXTRA * n // 100

    def least_shared(self, n):
        """Tokens that a set of this size shares in its prefix with any set it links with (which may be smaller)."""
        return 1 + F.floor(EXTRA * F.ceil(self.num * n / self.den) / 100)

    def overlap(self, a, b):
        """Least number of common tokens of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))


# ---- sets of shingles -------------------------------------------------------------------------

def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = textops.LOWER[raw]
    starts, ends, word_off = textops.words(low, off)
    h = textops.hash_spans(low, starts, ends)
    m = max(len(h) - k + 1, 0)
    s = np.zeros(m, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x100000001B3) + h[i:i + m]
    s = textops.mix64(s)
    out = []
    for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a:b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(textops.mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    total = np.add.reduce(textops.mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(textops.mix64(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _sets(rule: Rule, frequent):
    """Per document: size, node and prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value if frequent is not None else np.zeros(0, np.uint64)
        for batch in textops.chunks(batches, "text"):
            n, node, prefix, cuts = [], [], [], [0]
            with np.errstate(over="ignore"):
                for u in shingle_sets(*textops.utf8(batch.column("text")), rule.k):
                    n.append(len(u))
                    node.append(digest(u))
                    if len(u):
                        if len(last):
                            late = last[np.minimum(np.searchsorted(last, u), len(last) - 1)] == u
                            u = np.concatenate([u[~late], u[late]])
                        prefix.append(u[:rule.prefix(len(u))])
                        cuts.append(cuts[-1] + len(prefix[-1]))
                    else:
                        cuts.append(cuts[-1])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 textops.list_array(flat.view(np.int64), np.array(cuts), pa.int64())],
                names=["doc_id", "th", "n", "node", "prefix"])
    return run


def _sample_tokens(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "text"):
            with np.errstate(over="ignore"):
                sets = [u for u in shingle_sets(*textops.utf8(batch.column("text")), rule.k) if len(u)]
                nodes = [digest(u) for u in sets]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(nodes, np.int64), [len(u) for u in sets]), pa.int64()),
                     pa.array(np.concatenate(sets).view(np.int64), pa.int64())], names=["node", "token"])
    return run


def frequent_tokens(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted tokens that occur in several different sets of a document sample (for the order of tokens only)."""
    one_in = max(1, docs.count() // SAMPLE_DOCS)
    seen = (docs.where(F.pmod("th", F.lit(one_in)) == 0).select("text")
            .mapInArrow(_sample_tokens(rule), "node long, token long").distinct()
            .groupBy("token").count().where(F.col("count") >= SAMPLE_LEAST)
            .orderBy(F.desc("count"), "token").limit(FREQUENT_MAX).select("token").toArrow())
    return np.sort(seen.column("token").to_numpy().view(np.uint64))


def _in_slots(slots):
    """Documents whose slot is set in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            hit = (slots.value[slot // 32] >> (slot % 32).astype(np.uint32)) & 1
            yield batch.drop_columns(["slot"]).filter(pa.array(hit.astype(bool)))
    return run


def _full_sets(rule: Rule):
    """(node, n, tokens) of the documents whose set is the expected node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "text"):
            with np.errstate(over="ignore"):
                sets = shingle_sets(*textops.utf8(batch.column("text")), rule.k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(u) for u in sets], pa.int64()),
                 pa.array([u.tobytes() for u in sets], pa.binary())], names=["node", "n", "tokens"])
    return run


# ---- signature trees --------------------------------------------------------------------------

def bit_width(n: int) -> int:
    return max(64, 1 << int(np.ceil(np.log2(max(1, BITS_PER_TOKEN * n)))))


def bitmap(tokens: np.ndarray) -> bytes:
    """Token bitmap; a narrower one is the OR of the parts of a wider one."""
    width = bit_width(len(tokens))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``words`` words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


@dataclass
class Level:
    """Tree nodes of one level: bitmaps, size ranges, most tokens that share a bit, and their span of rows."""
    maps: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build_tree(maps: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the leaves (one document each) to the root."""
    rows = np.arange(len(sizes))
    set_bits = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    levels = [Level(maps, sizes, sizes, sizes - set_bits, rows, rows + 1)]
    while len(levels[-1].low) > 1:
        x = levels[-1]
        cut = np.arange(0, len(x.low), FANOUT)
        levels.append(Level(np.bitwise_or.reduceat(x.maps, cut, axis=0), np.minimum.reduceat(x.low, cut),
                            np.maximum.reduceat(x.high, cut), np.maximum.reduceat(x.slack, cut),
                            x.first[cut], x.last[np.minimum(cut + FANOUT, len(x.low)) - 1]))
    return levels


def possible(a: Level, i: np.ndarray, b: Level, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Node pairs whose sizes and largest possible overlap allow a link."""
    ok = (rule.den * a.high[i] >= rule.num * b.low[j]) & (rule.den * b.high[j] >= rule.num * a.low[i])
    at = np.flatnonzero(ok)
    for s in range(0, len(at), 4096):
        p = at[s:s + 4096]
        x, y = a.maps[i[p]], b.maps[j[p]]
        common = np.bitwise_count(x & y).sum(axis=1).astype(np.int64)
        # tokens of a set lie on bits; beyond one a bit there are at most `slack` more
        most = common + np.minimum(a.slack[i[p]], b.slack[j[p]])
        most = np.minimum(most, np.minimum(a.high[i[p]], b.high[j[p]]))
        ok[p] = most >= rule.overlap(a.low[i[p]], b.low[j[p]])
    return ok


def _expand(a: Level, i: np.ndarray, b: Level, j: np.ndarray, na: int, nb: int):
    """Children pairs of node pairs (``na``, ``nb``: nodes of the level below)."""
    ci, cj = i * FANOUT, j * FANOUT
    li, lj = np.minimum(FANOUT, na - ci), np.minimum(FANOUT, nb - cj)
    total = li * lj
    base = textops.ragged(np.zeros(len(i), np.int64), total)
    owner = textops.segments(total)
    return ci[owner] + base // lj[owner], cj[owner] + base % lj[owner]


#: Node pairs expanded at once (bounds a traversal's memory).
FRONT = 1 << 15


def traverse(a: list[Level], b: list[Level], same: bool, rule: Rule, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (i, j) that may link, in batches; ``skip(level a, i, level b, j)`` marks pairs not needed now."""
    stack = [(len(a) - 1, len(b) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        x, y, i, j = stack.pop()
        keep = ~skip(a[x], i, b[y], j)
        i, j = i[keep], j[keep]
        keep = possible(a[x], i, b[y], j, rule)
        i, j = i[keep], j[keep]
        if len(i) == 0:
            continue
        if x == 0 and y == 0:
            yield i, j
            continue
        # the higher tree goes down first; both when they are level
        nx, ny = (x - 1 if x >= y else x), (y - 1 if y >= x else y)
        for s in range(0, len(i), FRONT // (FANOUT * FANOUT)):
            p, q = i[s:s + FRONT // (FANOUT * FANOUT)], j[s:s + FRONT // (FANOUT * FANOUT)]
            if nx < x and ny < y:
                ci, cj = _expand(a[x], p, b[y], q, len(a[nx].low), len(b[ny].low))
            elif nx < x:
                n = np.minimum(FANOUT, len(a[nx].low) - p * FANOUT)
                ci, cj = textops.ragged(p * FANOUT, n), np.repeat(q, n)
            else:
                n = np.minimum(FANOUT, len(b[ny].low) - q * FANOUT)
                ci, cj = np.repeat(p, n), textops.ragged(q * FANOUT, n)
            if same:                        # each unordered pair once
                up = ci <= cj if nx or ny else ci < cj
                ci, cj = ci[up], cj[up]
            stack.append((nx, ny, ci, cj))


class Forest:
    """Components of a block's rows as flat labels, for whole-array tests."""

    def __init__(self, n: int, comp: np.ndarray | None = None):
        self.label = np.arange(n) if comp is None else np.unique(comp, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        x, y = self.label[i], self.label[j]
        self.label[self.label == max(x, y)] = min(x, y)


def _stack(maps: list[bytes], sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by bitmap width: (row numbers, bitmaps)."""
    width = np.array([len(m) for m in maps])
    return [(np.flatnonzero(width == w), np.frombuffer(b"".join(maps[r] for r in np.flatnonzero(width == w)), np.uint64)
             .reshape(-1, w // 8)) for w in np.unique(width)]


def block_links(nodes: np.ndarray, tokens: list[np.ndarray], rule: Rule,
                comp: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Verified links that span the components of one block (beside those of ``comp``): the tree joined with itself."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    # alike sets side by side: by size class, then by their least tokens
    order = sorted(range(len(nodes)), key=lambda r: (bit_width(sizes[r]), tokens[r][:2].tobytes(), sizes[r]))
    nodes, sizes, tokens = nodes[order], sizes[order], [tokens[r] for r in order]
    forest = Forest(len(nodes), comp if comp is None else comp[order])
    trees = [(rows, m, build_tree(m, sizes[rows])) for rows, m in _stack([bitmap(t) for t in tokens], sizes)]
    for x, side_a in enumerate(trees):
        for y in range(x, len(trees)):
            for r, s, _, _ in open_pairs(side_a, trees[y], x == y, sizes, forest, rule):
                for r, s in zip(r.tolist(), s.tolist()):
                    if forest.label[r] != forest.label[s]:
                        shared = len(np.intersect1d(tokens[r], tokens[s], assume_unique=True))
                        if shared >= rule.overlap(sizes[r], sizes[s]):
                            forest.join(r, s)
                            yield int(nodes[r]), int(nodes[s])


def open_pairs(side_a, side_b, same: bool, sizes: np.ndarray, forest: Forest, rule: Rule):
    """Rows (and their bitmaps) that may link across the forest's components; a side is (rows, bitmaps, tree)."""
    (rows_a, maps_a, tree_a), (rows_b, maps_b, tree_b) = side_a, side_b
    wide_a, wide_b = maps_a.shape[1], maps_b.shape[1]
    if max(wide_a, wide_b) > 2 * min(wide_a, wide_b):     # sizes within num/den differ by one width at most
        return
    if wide_a > wide_b:
        tree_a = build_tree(fold(maps_a, wide_b), sizes[rows_a])
    elif wide_b > wide_a:
        tree_b = build_tree(fold(maps_b, wide_a), sizes[rows_b])
    la, lb = _Labels(forest, rows_a), _Labels(forest, rows_b)

    def skip(a, i, b, j):
        lo_a, hi_a = la.range(a)
        lo_b, hi_b = lb.range(b)
        return (lo_a[i] == hi_a[i]) & (lo_b[j] == hi_b[j]) & (lo_a[i] == lo_b[j])

    for i, j in traverse(tree_a, tree_b, same, rule, skip):
        yield rows_a[i], rows_b[j], tree_a[0].maps[i], tree_b[0].maps[j]


class _Labels:
    """Least and largest label under each tree node."""

    def __init__(self, forest: Forest, rows: np.ndarray):
        self.forest, self.rows = forest, rows

    def range(self, level: Level) -> tuple[np.ndarray, np.ndarray]:
        label = self.forest.label[self.rows]
        return np.minimum.reduceat(label, level.first), np.maximum.reduceat(label, level.first)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, each as one table (a run is at most a block or two)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = list(zip(*[batch.column(c).to_pylist() for c in keys]))
        cut = [0] + [i for i in range(1, len(k)) if k[i] != k[i - 1]] + [len(k)]
        for a, b in zip(cut, cut[1:]):
            if last is not None and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                       pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _first_pass(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["key", "block"]):
            if t.num_rows > 1:
                nodes = t.column("node").to_numpy()
                tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
                found = list(block_links(nodes, tokens, rule))
                if found:
                    yield _pairs(found)
    return run


def may_link(token: int, lo: int, hi: int, t: pa.Table, rule: Rule) -> Iterator[np.ndarray]:
    """Rows of a meeting (blocks ``lo`` and ``hi`` of a token) whose components the bitmaps allow to link, by what they may make."""
    sizes, side, least = (t.column(c).to_numpy() for c in ("n", "block", "least"))
    forest = Forest(t.num_rows, t.column("comp").to_numpy())
    before = forest.label.copy()
    maps, order = t.column("map").to_pylist(), np.lexsort((sizes, before))
    parts = []
    for b in dict.fromkeys((lo, hi)):
        rows = order[side[order] == b]
        parts.append([(rows[r], m, build_tree(m, sizes[rows[r]])) for r, m in _stack([maps[r] for r in rows], sizes[rows])])
    for x, side_a in enumerate(parts[0]):
        for y, side_b in enumerate(parts[-1]):
            if lo == hi and y < x:
                continue
            for r, s, p, q in open_pairs(side_a, side_b, lo == hi and x == y, sizes, forest, rule):
                # the leaf bound on each side's missing bits
                need = rule.overlap(sizes[r], sizes[s])
                # nodes with one least token meet under it, and are left to that meeting
                ok = (least[r] != least[s]) | (least[r] == token)
                ok &= ((sizes[r] - np.bitwise_count(p & ~q).sum(axis=1) >= need)
                       & (sizes[s] - np.bitwise_count(q & ~p).sum(axis=1) >= need))
                r, s = r[ok], s[ok]
                while len(r):
                    forest.join(r[0], s[0])
                    apart = forest.label[r] != forest.label[s]
                    r, s = r[apart], s[apart]
    for label in np.unique(forest.label[forest.label != before]):
        yield np.flatnonzero(forest.label == label)


def _second_pass(rule: Rule):
    """Nodes of different components whose bitmaps allow a link, under a name of all that they may make together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["token", "low", "high"]):
            nodes, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
            for rows in may_link(*[t.column(c)[0].as_py() for c in ("token", "low", "high")], t, rule):
                with np.errstate(over="ignore"):
                    name = digest(nodes[rows].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name), pa.int64()), pa.array(nodes[rows], pa.int64()),
                                                  pa.array(comp[rows], pa.int64())], names=["meeting", "node", "comp"])
    return run


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([bitmap(np.frombuffer(x, np.uint64)) for x in batch.column("tokens").to_pylist()],
                                            pa.binary())], names=["node", "map"])


def _verify(rule: Rule):
    """Links of the sets of nodes that the second pass hands on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["meeting"]):
            tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("tokens")]
            found = list(block_links(t.column("node").to_numpy(), tokens, rule, t.column("comp").to_numpy()))
            if found:
                yield _pairs(found)
    return run


# ---- the join ---------------------------------------------------------------------------------

def jaccard_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, th, n_shingles, node, component_id, root) of every row of ``docs(doc_id, text)``.

    ``root`` names the component also where ids are null or repeated; it is null for documents without links
    to other sets, whose component is their node (documents without shingles: themselves).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("th"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, rule))
    sets = materialize(docs.mapInArrow(_sets(rule, frequent), "doc_id long, th long, n long, node long, prefix array<long>"),
                       "jaccard-sets")
    classes = sets.where("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # prefix tokens that two nodes share; counts and rows come from one exchange
    index = (classes.select("node", "n", F.explode("prefix").alias("token"))
             .repartition(F.col("token")))
    shared = index.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    index = materialize(index.join(shared, "token"), "jaccard-index")
    # sets that share enough; what they share is counted again among them
    passed = (index.groupBy("node").agg(F.count("*").alias("met"), F.first("n").alias("n"))
              .where(F.col("met") >= rule.least_shared(F.col("n"))).select("node"))
    index = index.drop("df").join(passed, "node", "left_semi")
    # tokens of the same nodes (by two hashes) bring the same ones together: one of them stays
    shared = index.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("df > 1")
    shared = shared.groupBy("df", "x", "y").agg(F.min("token").alias("token")).select("token", "df")
    index = materialize(index.join(shared, "token"), "jaccard-index")
    first = index.groupBy("node").agg(F.min(F.struct("token", "df")).alias("m"))
    wanted = materialize(classes.select("node", "rep").join(first, "node").select(
        "node", "rep.doc_id", "rep.th", F.col("m.token").alias("key"), F.col("m.df").alias("df")), "jaccard-wanted")
    slot = F.pmod(F.xxhash64("th"), F.lit(SLOTS))
    bits = (wanted.groupBy(F.floor(slot / 32).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(th), {SLOTS}) % 32 as int))")).alias("bits")).toArrow())
    slots = np.zeros(SLOTS // 32, np.uint32)
    slots[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    slots = spark.sparkContext.broadcast(slots)
    w = wanted.alias("w")
    d = docs.withColumn("slot", slot).mapInArrow(_in_slots(slots), "doc_id long, text string, th long").alias("d")
    full = (d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")))
            .select("w.node", "d.text").mapInArrow(_full_sets(rule), "node long, n long, tokens binary"))
    full = materialize(full, "jaccard-full")

    # first pass: under the first shared token, in blocks; groups beyond a block are dealt DEALS times
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    deals = F.explode(F.when(blocks > 1, F.array(*[F.lit(i) for i in range(DEALS)])).otherwise(F.array(F.lit(0))))
    placed = (full.join(wanted.select("node", "key", "df"), "node").withColumn("deal", deals)
              .withColumn("block", F.col("deal") * blocks + F.pmod(F.xxhash64("node", "deal"), blocks).cast("int")))
    links = (placed.select("key", "block", "node", "tokens").repartition("key", "block")
             .sortWithinPartitions("key", "block", "node").mapInArrow(_first_pass(rule), "a long, b long"))
    links = materialize(links, "jaccard-links")
    comp = materialize(components(links), "jaccard-comps")

    # second pass: tokens that still join different components
    labelled = (index.select("token", "node", "df").join(comp, "node", "left")
                .select("token", "node", "df", F.coalesce("root", "node").alias("comp")))
    open_ = labelled.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    k = F.ceil(F.col("df") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), k).cast("int")
    joined = labelled.join(open_, "token")
    least = joined.groupBy("node").agg(F.min("token").alias("least"))
    rows = (joined.withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
            .select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "block", "node", "comp"))
    maps = (full.select("node", "tokens").mapInArrow(_maps, "node long, map binary").join(full.select("node", "n"), "node")
            .join(least, "node"))
    meetings = (rows.join(maps, "node").repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "node")
                .mapInArrow(_second_pass(rule), "meeting long, node long, comp long").distinct())
    more = (meetings.join(full.select("node", "tokens"), "node").repartition("meeting").sortWithinPartitions("meeting", "node")
            .select("meeting", "node", "comp", "tokens").mapInArrow(_verify(rule), "a long, b long"))
    found = materialize(more.unionByName(comp.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))),
                        "jaccard-links")
    comp = materialize(components(found), "jaccard-comps")

    named = classes.select("node", F.col("rep.doc_id").alias("rep_id")).join(comp, "node", "left")
    ids = named.groupBy(F.coalesce("root", "node").alias("name")).agg(F.min("rep_id").alias("component_id"))
    named = named.select("node", "root", F.coalesce("root", "node").alias("name")).join(ids, "name")
    return (sets.select("doc_id", "th", "n", "node").join(named.select("node", "root", "component_id"), "node", "left")
            .select("doc_id", "th", F.col("n").alias("n_shingles"), "node", "root",
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group (five words, similarity 0.8).

    The one with the smallest id stays; documents without words are all kept.
    """
    groups = jaccard_groups(docs, Rule(5, 80, 100))
    name = F.coalesce("root", "node")
    best = (groups.where("n_shingles > 0").groupBy(name.alias("name"))
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")).alias("b"))
            .select(F.col("b.doc_id").alias("k_id"), F.col("b.th").alias("k_th")))
    names = docs.columns
    same = Window.partitionBy("k_id", "k_th").orderBy("k_id")
    d = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)],
                    F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_th"))
    b = best.alias("b")
    kept = (d.alias("d").join(b, F.col("d.k_id").eqNullSafe(F.col("b.k_id")) & (F.col("d.k_th") == F.col("b.k_th")), "left_semi")
            .withColumn("rank", F.row_number().over(same)).where("rank = 1").drop("rank"))
    rest = d.where(~F.coalesce(F.col(f"c_{names.index('text')}"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(rest).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])
