"""Conversation prefix trie by vertical bitmaps.

Every distinct sequence of first turns is a node; its members are the
conversations that start with it.  Conversations are cut in shards of
``2 ** SHARD_BITS`` ids.  A shard's vertical index maps (position, turn) to the
bitset of the shard's conversations with that turn there.  A depth-first walk
starts with the bitset of all, and intersects the bitset of a node with the
postings of the next position: each non-empty intersection is a child, its
population count the shard's members, and the members without a next turn are
the shard's end list of the node.  Spark then merges the shards' nodes by the
hash of their path.

Long conversations: turns are dealt in blocks of ``BLOCK`` positions, and a
shard walks one block; where a block starts, conversations are told apart by a
hash of all blocks before.  So no task holds a whole conversation.

Flow: turns become 16-byte hashes and text lengths where they are read, and no
text is shuffled.  Positions come from range-split running sums (repeated rows
count as one row with a multiplicity), subtree sums from the same over chains:
the nodes whose smallest member is the same conversation form one downward
path, so the trie is a tree of such chains, summed up by pointer doubling.

Skew: one conversation may hold a third of all turns, one turn may open a third
of all conversations, and one node may have that many children or end members.
Positions and suffix sums are split by range; children meet their parent under
``SALTS`` salts; end lists arrive as one text a shard and are hashed as a
stream, in id order.

Defined cases: null role or text counts as empty; null turn comes first; rows
of equal turn are ordered by the SHA-256 of role and text; repeated rows are
turns of their own; rows without a conv_id belong to no conversation and are
left out; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm.sources import materialize, table
from tokentally.operators.running import range_sums

#: Conversation ids of a shard: this many low bits.
SHARD_BITS = 10
#: Positions of a block.
BLOCK = 256
#: Salts under which the children of a node meet it.
SALTS = 64
#: Path hash of the root.
ROOT = bytes(16)

TURN = "struct<pos:bigint,turn:binary,size:bigint>"
SHARD_NODES = ("key binary, parent binary, depth long, n_convs long, conv_id long, size long, ends string, shard long")


# ---- turns of the conversations ---------------------------------------------------------------

def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, size, start, times, length): a conversation's turns in order, as runs of equal rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role keeps (role, text) apart from any other pair
    name = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"),
        F.unhex(F.substring(name, 1, 32)).alias("turn"), F.char_length(text).cast("long").alias("size"))
    runs = rows.groupBy("conv_id", "at", "turn", "size").agg(F.count("*").alias("times"))
    placed = range_sums(runs, "conv_id", ["at", "turn"], ("times",), totals=True)
    return placed.select("conv_id", "turn", "size", (F.col("run_times") - F.col("times")).alias("start"), "times",
                         F.col("all_times").alias("length"))


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are branched: (conv_id, pos, turn, size, length) and (conv_id, length).

    Conversation c is the first h turns of conversation c - c % group, then its own turns after its first h;
    h = crc32(decimal c) % most.  A donor's turns go to at most ``group`` conversations, ``most`` - 1 each."""
    runs = materialize(numbered(conversations), "turns")
    last = F.col("start") + F.col("times") - 1
    every = runs.groupBy("conv_id").agg(F.max("length").alias("own"))
    every = every.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("donor"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = (runs.where((F.col("conv_id") % group == 0) & (F.col("start") < most - 1))
             .select(F.col("conv_id").alias("donor"),
                     F.explode(F.sequence("start", F.least(last, F.lit(most - 2).cast("long")))).alias("pos"), "turn", "size")
             .groupBy("donor").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "size"))).alias("head")))
    none = F.array().cast(f"array<{TURN}>")
    convs = (every.join(heads, "donor", "left")
             .withColumn("head", F.coalesce(F.expr("slice(head, 1, int(h))"), none))
             .withColumn("k", F.size("head").cast("long"))
             .withColumn("length", F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))))
    convs = materialize(convs.select("conv_id", "own", "h", "k", "length", "head"), "convs")
    borrowed = convs.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", "t.pos", "t.turn", "t.size", "length")
    # own turns meet their conversation by stretches of BLOCK turns: no key holds more rows
    stretches = convs.where("own > h").select("conv_id", "h", "k", F.col("length").alias("all"), F.explode(
        F.sequence(F.expr(f"h div {BLOCK}"), F.expr(f"(own - 1) div {BLOCK}"))).alias("stretch"))
    own = (runs.select("conv_id", "turn", "size", F.explode(F.sequence("start", last)).alias("pos"))
           .withColumn("stretch", F.expr(f"pos div {BLOCK}"))
           .join(stretches, ["conv_id", "stretch"]).where("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn", "size", F.col("all").alias("length")))
    return borrowed.unionByName(own), convs.select("conv_id", "length")


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, in the same two tables."""
    runs = materialize(numbered(conversations), "turns")
    last = F.col("start") + F.col("times") - 1
    turns = runs.select("conv_id", F.explode(F.sequence("start", last)).alias("pos"), "turn", "size", "length")
    return turns, runs.groupBy("conv_id").agg(F.max("length").alias("length"))


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, length, turns, start, next): blocks of at most ``block`` turns, with the path hashes of
    the nodes at their start and behind them."""
    cut = (turns.groupBy("conv_id", F.expr(f"pos div {block}").alias("block"))
           .agg(F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("pos", "turn", "size"))).alias("turns")))
    bare = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), "length",
                                            F.array().cast(f"array<{TURN}>").alias("turns"))
    cut = materialize(cut.unionByName(bare), "blocks")
    root, unknown = F.lit(ROOT), F.lit(None).cast("binary")
    short = cut.where(F.col("length") < block).withColumns({"start": root, "next": unknown})
    # the path before a block is known by sums of hashes of (block, its turns), exact and free of order
    name = F.sha2(F.concat(F.col("block").cast("string"), F.lit(":"), F.array_join(F.transform("turns", lambda t: F.hex(t["turn"])), "")), 256)
    long = cut.where(F.col("length") >= block)
    names = long.select("conv_id", "block", name.alias("name")).select("conv_id", "block", *[
        F.conv(F.substring("name", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"x{i}") for i in (0, 1)])
    sums = range_sums(names, "conv_id", ["block"], ("x0", "x1"))

    def path(number, *sums):
        return F.unhex(F.substring(F.sha2(F.concat_ws("/", number.cast("string"), *[c.cast("decimal(38,0)").cast("string") for c in sums]), 256), 1, 32))
    paths = sums.select(
        "conv_id", "block", path(F.col("block") + 1, F.col("run_x0"), F.col("run_x1")).alias("next"),
        F.when(F.col("block") == 0, root).otherwise(
            path(F.col("block"), F.col("run_x0") - F.col("x0"), F.col("run_x1") - F.col("x1"))).alias("start"))
    return short.unionByName(long.join(paths, ["conv_id", "block"]))


# ---- the walk of a shard ----------------------------------------------------------------------

def walk(ids: list[int], turns: list[list[tuple[bytes, int]]], lengths: list[int], starts: list[bytes],
         nexts: list[bytes | None], number: int, block: int) -> Iterator[tuple]:
    """Nodes of one block of a shard: (key, parent, depth, members, smallest member, size, end list).

    ``ids`` ascend; bit i of a bitset is conversation ``ids[i]``."""
    base = number * block
    postings: list[dict[bytes, int]] = []
    ending: dict[int, int] = {}
    tops: dict[bytes, int] = {}
    for i, row in enumerate(turns):
        bit = 1 << i
        while len(postings) < len(row):
            postings.append({})
        for posting, (turn, _) in zip(postings, row):
            posting[turn] = posting.get(turn, 0) | bit
        if lengths[i] - base <= block:
            ending[lengths[i] - base] = ending.get(lengths[i] - base, 0) | bit
        tops[starts[i]] = tops.get(starts[i], 0) | bit
    stack = [(bits, 0, key, None, 0) for key, bits in tops.items()]
    while stack:
        bits, place, key, parent, size = stack.pop()
        ended = bits & ending.get(place, 0)
        if place or not number:                       # else the block before gives the node
            names, left = [], ended
            while left:
                low = left & -left
                names.append(str(ids[low.bit_length() - 1]))
                left ^= low
            first = ids[(bits & -bits).bit_length() - 1]
            yield key, parent, base + place, bits.bit_count(), first, size, ",".join(names) or None
        if place == block:                            # the next block goes on
            continue
        rest = bits ^ ended
        while rest:
            i = (rest & -rest).bit_length() - 1
            turn, size = turns[i][place]
            child = rest & postings[place][turn]
            rest ^= child
            path = nexts[i] if place + 1 == block else hashlib.blake2b(key + turn, digest_size=16).digest()
            stack.append((child, place + 1, path, key, size))


def shard_nodes(cut: DataFrame, block: int = BLOCK, bits: int = SHARD_BITS) -> DataFrame:
    """Nodes of all shards and blocks."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["conv_id"])
        out = list(walk([r["conv_id"] for r in rows], [[(t["turn"], t["size"]) for t in r["turns"]] for r in rows],
                        [r["length"] for r in rows], [r["start"] for r in rows], [r["next"] for r in rows],
                        rows[0]["block"], block))
        kinds = [pa.binary(), pa.binary()] + [pa.int64()] * 4 + [pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)]
        return pa.Table.from_arrays(arrays + [pa.array([rows[0]["shard"]] * len(out), pa.int64())],
                                    names=[f.split()[0] for f in SHARD_NODES.split(", ")])

    return (cut.withColumn("shard", F.shiftright("conv_id", bits)).groupBy("shard", "block")
            .applyInArrow(run, SHARD_NODES))


# ---- merge ------------------------------------------------------------------------------------

def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, shard, ends): the lists of a key, in shard order, hashed as one stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, done = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k == key:
                    sha.update(b"," + text.encode())
                    continue
                if sha is not None:
                    keys.append(key)
                    done.append(sha.hexdigest())
                key, sha = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(done, pa.string())], names=["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())],
                                             names=["key", "ends_sha256"])

    return (ends.select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
            .mapInArrow(run, "key binary, ends_sha256 string"))


def salted_lookup(rows: DataFrame, on: str, salt: str, values: DataFrame) -> DataFrame:
    """``rows`` left joined with ``values`` (one row a value of ``on``); a value shared by many rows is dealt
    out under ``SALTS`` salts of the column ``salt``."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    places = rows.where(F.col(on).isNotNull()).select(on, "_salt").distinct().join(values, on)
    return rows.join(places, [on, "_salt"], "left").drop("_salt")


def merged(shards: DataFrame) -> DataFrame:
    """Nodes with members, parent, number of children and end list hash."""
    shards = materialize(shards, "trie-shards")
    nodes = shards.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.min("size").alias("size"))
    nodes = materialize(nodes, "trie-nodes")
    ends = end_hashes(shards.where("ends is not null"))
    kids = (nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")))
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (salted_lookup(nodes, "parent", "key", up).join(kids, "key", "left").join(ends, "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "size", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def with_subtrees(nodes: DataFrame) -> DataFrame:
    """Adds n_leaves and saved_tokens, summed over each node's subtree."""
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    nodes = materialize(nodes.withColumns({"w_leaf": leaf, "w_saved": (F.col("n_convs") - 1) * F.col("size")}), "trie-rows")
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("up"),
                                          F.sum("w_leaf").alias("leaves"), F.sum("w_saved").alias("saved"))
    chains = materialize(chains, "chains")
    # sums over all chains within distance 2, 4, 8, ... below
    state = chains.select("conv_id", F.col("up").alias("far"), "leaves", "saved")
    while not state.where("far is not null").isEmpty():
        below = (state.where("far is not null").groupBy(F.col("far").alias("conv_id"))
                 .agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))
        jump = state.select(F.col("conv_id").alias("far"), F.col("far").alias("farther"))
        state = materialize(
            salted_lookup(state, "far", "conv_id", jump).join(below, "conv_id", "left").select(
                "conv_id", F.col("farther").alias("far"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chain-sums")
    hung = (chains.where("up is not null").select("conv_id", "up", "top").join(state.select("conv_id", "leaves", "saved"), "conv_id")
            .groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth"))
            .agg(F.sum("leaves").alias("h_leaf"), F.sum("saved").alias("h_saved")))
    whole = nodes.join(hung, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256",
        *[(F.col(f"w_{c}") + F.coalesce(f"h_{c}", F.lit(0))).alias(f"x_{c}") for c in ("leaf", "saved")])
    sums = range_sums(whole, "conv_id", ["depth"], ("x_leaf", "x_saved"), totals=True)
    below = {c: (F.col(f"all_x_{c}") - F.col(f"run_x_{c}") + F.col(f"x_{c}")).cast("long") for c in ("leaf", "saved")}
    return sums.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", below["leaf"].alias("n_leaves"),
                       below["saved"].alias("saved_tokens"), "ends_sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, bits: int = SHARD_BITS) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, pos, turn, size, length) and ``convs`` (conv_id, length)."""
    return with_subtrees(merged(shard_nodes(blocks(turns, convs, block), block, bits)))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; see the module's docstring."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
