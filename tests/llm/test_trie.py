"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from tokentally.llm import op12_trie as T
from tokentally.llm.queries import QUERIES

CONVS = "conv_id long, turn long, role string, text string, size long, block int, key string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Turns of each conversation, in the defined order."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, name, (role, text)))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def branched(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = convs.get(donor, [])[:h] + own[h:]
    return out


def expected(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, ids in members.items():
        worth = (len(ids) - 1) * (len(path[-1][1]) if path else 0)
        for d in range(len(path) + 1):
            saved[path[:d]] = saved.get(path[:d], 0) + worth
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
    rows = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(path)))
        rows.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), kids.get(path, 0),
                     leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def got(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=repr)


def random_rows(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -1, -7, -100, 10 ** 12, 10 ** 12 + 3]:
        length = rng.choice([1, 1, 2, 3, 5, 8, 30])
        for t in range(length):
            turn = rng.choice([t, t, t, None, 0])
            rows.append((c, turn, rng.choice(["user", "", None]), rng.choice(["a", "é" * 5, "", None, "a"]), 1, 2, "k"))
    rows += [(None, 0, "user", "lost", 0, 0, "")] * 2 + rows[:5]
    return rows


@pytest.mark.parametrize("block,bits", [(T.BLOCK, T.SHARD_BITS), (4, 3), (1, 0)])
def test_trie_equals_a_dictionary(spark, block, bits):
    rows = random_rows(block)
    df = spark.createDataFrame(rows, CONVS)
    want = expected(branched(ordered(rows)))
    assert max(r[1] for r in want) > 20 and any(r[3] > 20 and r[1] > 1 for r in want)
    assert got(T.prefix_trie(*T.rebuilt(df), block, bits)) == want


def test_plain_conversations(spark):
    rows = random_rows(9, 60)
    assert got(T.prefix_trie(*T.plain(spark.createDataFrame(rows, CONVS)), 8, 4)) == expected(ordered(rows))


def test_query_on_a_long_conversation_and_turnless_ones(spark, write_tables):
    rows = [(7, t, "user", f"turn {t}", 1, 1, "") for t in range(700)]
    rows += [(8, t, "user", f"turn {t}", 1, 1, "") for t in range(512)]             # ends where a block does
    rows += [(c, 0, "user", "hello " * 50_000 if c == 950 else "hi", 1, 1, "") for c in range(900, 990)]   # donor 900
    rows += [(c, 0, "user", "hi", 1, 1, "") for c in range(1001, 1090)]             # without donor: some turnless
    d = write_tables(conversations=(rows, CONVS))
    want = expected(branched(ordered(rows)))
    root = next(r for r in want if r[1] == 0)
    assert root[7] != hashlib.sha256(b"").hexdigest() and max(r[1] for r in want) >= 695
    assert got(QUERIES["op12_trie"](spark, d)) == want


def test_empty_and_nameless(spark, write_tables):
    d = write_tables(conversations=([(None, 1, "user", "x", 1, 1, "")], CONVS))
    assert QUERIES["op12_trie"](spark, d).collect() == []


def test_walk_of_shards_adds_up():
    rng = random.Random(3)
    ids = list(range(50))
    turns = [[(bytes([rng.randint(0, 2)]) * 16, 1) for _ in range(rng.randint(0, 6))] for _ in ids]
    whole = list(T.walk(ids, turns, [len(t) for t in turns], [T.ROOT] * 50, [None] * 50, 0, 100))
    halves = [list(T.walk(ids[a:b], turns[a:b], [len(t) for t in turns[a:b]], [T.ROOT] * 25, [None] * 25, 0, 100))
              for a, b in ((0, 25), (25, 50))]
    count = {}
    for row in halves[0] + halves[1]:
        count[row[0]] = count.get(row[0], 0) + row[3]
    assert count == {row[0]: row[3] for row in whole}
