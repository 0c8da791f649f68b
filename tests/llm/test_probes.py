"""Probes of single operators: null ids, texts that repeat themselves."""

import random
import resource
import time

import pyarrow as pa
import pytest

from tokentally.llm import op7_decontaminate, textops


def matches(items, texts):
    index = op7_decontaminate.build_index(items)
    return op7_decontaminate._finder([index])()(*textops.utf8(pa.array(texts, pa.large_string())))[0].to_pylist()


def test_items_without_id_are_found():
    item = "what is the name of the river that runs through the old town"
    got = matches([(None, item), (3, item), (None, None), (4, "")], [f"before {item} after", "nothing here"])
    assert [m["item_id"] for m in got[0]] == [3, None] and got[1] == []


def test_query_with_items_without_id(spark, write_tables):
    from tokentally.llm.queries import QUERIES
    item = "what is the name of the river that runs through the old town"
    d = write_tables(documents=([(1, f"x {item} y"), (2, "other")], "doc_id long, text string"),
                     benchmark=([(None, item), (8, item), (None, None)], "item_id long, text string"))
    rows = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in QUERIES["op7_decontaminate"](spark, d).collect()}
    assert rows == {1: (True, [8, None]), 2: (False, [])}


def test_one_letter_text_takes_bounded_memory():
    items = [(i, f"these words begin item {i} " * 3 + "a" * 600 + f" and these end it {i}" * 3) for i in range(5)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.process_time()
    assert matches(items, ["a" * 20_000]) == [[]]
    assert time.process_time() - start < 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_a_shared_line_costs_no_alignments():
    rng = random.Random(3)
    line = "which of the following statements about the text is correct "
    items = [(i, line + " ".join(rng.choice("abcdefgh") * rng.randint(2, 7) for _ in range(12))) for i in range(20)]
    start = time.process_time()
    assert matches(items, [line * 115]) == [[]]
    assert time.process_time() - start < 3
    assert [m["item_id"] for m in matches(items, [line * 20 + items[7][1] + " " + line * 20])[0]] == [7]


@pytest.mark.parametrize("seed", range(4))
def test_holds_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    for _ in range(60):
        item = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12)))
        region = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25)))
        row = [0] * (len(region) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, r in enumerate(region):
                new.append(min(row[j] + (c != r), row[j + 1] + 1, new[j] + 1))
            row = new
        for k in range(4):
            assert op7_decontaminate.holds(item, region, k) == (min(row) <= k)


@pytest.mark.parametrize("size", [1 << 20, 700, 60])
def test_counts_do_not_depend_on_the_slices(monkeypatch, size):
    rng = random.Random(size)
    items = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(12, 80)))) for i in range(6)]
    items += [(9, "a" * 40), (10, "b" * 20 + "a" * 30)]
    texts = ["".join(rng.choice("ab ") * rng.choice([1, 1, 30]) for _ in range(100)) + (items[i][1] or "") for i in range(4)]
    want = matches(items, texts)
    monkeypatch.setattr(op7_decontaminate, "SLICE", size)
    monkeypatch.setattr(op7_decontaminate, "TABLE", 1 if size == 700 else 1 << 22)
    monkeypatch.setattr(op7_decontaminate, "RUN_PAIRS", 1 if size == 60 else 1 << 30)
    assert matches(items, texts) == want
