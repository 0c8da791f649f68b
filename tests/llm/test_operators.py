"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokentally.llm import (attention, op1_html, op2_toxicity, op3_lm, op4_jaccard, op5_mix, op6_perplexity,
                            op7_decontaminate, op8_licenses, op9_token_file, op10_quotes, textops)
from tokentally.llm.subwords import PieceEncoder, default_tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def column(texts):
    return textops.utf8(pa.array(texts, pa.large_string()))


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---- helpers ----------------------------------------------------------------------------------

@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0bé　Z", max_size=20)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    raw, off = column(texts)
    s, e, w = textops.words(raw, off)
    got = [[raw[i:j].tobytes() for i, j in zip(s[a:b], e[a:b])] for a, b in zip(w, w[1:])]
    assert got == [WORD.findall((t or "").encode()) for t in texts]
    h = textops.hash_spans(raw, s, e)
    by = {}
    for x, i, j in zip(h.tolist(), s, e):
        assert by.setdefault(raw[i:j].tobytes(), x) == x
    assert len(set(by.values())) == len(by)


# ---- 1 HTML -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- ad --><div class="ad">Buy</div><div id="main" class="layout-12 with-sidebar"><article><h1>Title &amp; more</h1><p><b>One
  two.<br><p>Three &lt;x&gt;</p><form><input><p>mail</p></form><div class="comments"><p>First comment is long long long</p></div>
</article><aside>side</aside></div><footer>&copy; f</footer></body></html>"""


def test_html_text():
    text, _ = op1_html.extract(PAGE, None)
    assert text == "Title & more\nOne two.\nThree <x>"
    assert op1_html.extract("", None) == ("", False)
    assert op1_html.extract("plain words", None)[0] == "plain words"


@pytest.mark.parametrize("attributes, hides", [
    ('class="post overflow-hidden"', False), ('title="a hidden place"', False), ("data-x='hidden'", False),
    ('data-style="display:none"', False), ('style="overflow:hidden"', False), ('aria-hidden="false"', False),
    ('hidden="false"', False), ("data-hidden", False), ('title="a" hidden', True), ("HIDDEN=''", True), ('hidden="hidden"', True),
    ('style="color:red; display : none"', True), ("style='visibility:hidden'", True), ("aria-hidden=true", True)])
def test_html_hidden_is_an_attribute(attributes, hides):
    page = f"<body><div><p>Seen words.</p><div {attributes}><p>Words in question.</p></div></div></body>"
    assert ("Words in question." in op1_html.extract(page, None)[0]) != hides


@pytest.mark.parametrize("tag", ["svg-icon", "object-view", "title-bar", "template-x", "style.x", "script:x", "form_x"])
def test_html_tags_that_begin_like_junk(tag):
    text, _ = op1_html.extract(f"<body><div><p>One.</p><{tag} name='a'></{tag}><p>Two.</p></div></body>", None)
    assert text == "One.\nTwo."
    assert op1_html.extract("<body><div><p>One.</p><svg\nid=a><text>x</text></svg><p>Two.</p></div></body>", None)[0] == "One.\nTwo."


def test_html_host_consensus(spark):
    shared = "<html><body><div class='post-{i}'><p>{t}</p></div><div class='box'><p>{b}</p></div></body></html>"
    pages = [(i, f"http://h.example/{i}", shared.format(i=i, t="article words, many of them. " * 9, b="short")) for i in range(6)]
    # one page whose box is longer than its article: the host's path still wins
    pages.append((9, "http://h.example/9", shared.format(i=9, t="brief article", b="a longer box text, really longer. " * 9)))
    pages += [(10, None, None), (11, "no url", "<p>x</p>")]
    rows = {r["page_id"]: r for r in op1_html.extract_pages(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows[9]["text"] == "brief article" and rows[9]["on_host_path"]
    assert rows[9]["host_path"] == "/html/body/div.post-0"
    assert rows[10]["text"] == "" and rows[10]["n_chars"] == 0 and rows[11]["text"] == "x"


# ---- 2 toxicity -------------------------------------------------------------------------------

def test_toxicity_held_out():
    rng = random.Random(5)
    syllables = ["ka", "to", "mi", "re", "su", "no", "vel", "dar"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grumblox", "snarfwit", "blighted", "zorkhead"]

    def text(toxic):
        w = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(max(2, len(w) // 30) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    model = op2_toxicity.fit(pa.array([text(True) for _ in range(150)]), pa.array([text(False) for _ in range(300)]))
    gaps = op2_toxicity.Gaps(model)
    held = [(text(x), x) for x in (True, False) for _ in range(100)]
    score = 1 / (1 + np.exp(-op2_toxicity.evidence(gaps, *column([t for t, _ in held])) @ model.weights))
    right = np.mean([(s >= 0.5) == x for s, (_, x) in zip(score, held)])
    assert right >= 0.97
    assert 0 <= score.min() and score.max() <= 1


def test_toxicity_without_labels():
    model = op2_toxicity.fit(pa.array([], pa.string()), pa.array(["a"]))
    x = op2_toxicity.evidence(op2_toxicity.Gaps(model), *column(["a b", "", None]))
    assert (1 / (1 + np.exp(-x @ model.weights)) < 0.5).all()


def test_toxicity_threshold_above_and_below_the_bound():
    """Fitted on samples of both classes with their true numbers, the scores keep the level of the whole fit."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "re", "su", "no", "vel", "dar"]) for _ in range(rng.randint(2, 4)))

    def text(times):
        w = [word() for _ in range(60)]
        for _ in range(times):
            w.insert(rng.randrange(len(w)), rng.choice(["grumblox", "snarfwit", "zorkhead"]))
        return " ".join(w)

    toxic = [text(rng.choice([0, 1, 1, 2])) for _ in range(200)]
    clean = [text(int(rng.random() < 0.02)) for _ in range(1800)]
    score = {}
    for n in (1800, 200):                                       # 9 : 1 as they are, and 1 : 1
        model = op2_toxicity.fit(pa.array(toxic), pa.array(clean[:n]), (200, 1800))
        x = op2_toxicity.evidence(op2_toxicity.Gaps(model), *column(toxic + clean))
        score[n] = 1 / (1 + np.exp(-x @ model.weights))
    assert abs(score[1800].mean() - 0.1) < 0.02 and abs(score[200].mean() - 0.1) < 0.03, score


def test_toxicity_counts_both_classes_beyond_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op2_toxicity, "fit", lambda toxic, ordinary, known: seen.append((len(toxic), len(ordinary), known)))
    d = spark.createDataFrame([(i, "t" if i % 50 else None) for i in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(450)], "doc_id long, toxic int")
    op2_toxicity.train(d, known, 20)
    kept = [i for i in range(400) if i % 50 and zlib.crc32(str(i).encode()) % 5]
    true = sum(i % 10 == 1 for i in kept)
    assert seen == [(20, 20, (true, len(kept) - true))]


# ---- 3 language model -------------------------------------------------------------------------

def test_attention_gradient_and_total_probability():
    rng = np.random.default_rng(0)
    counts, starts = np.array([5, 3, 0, 9, 1, 2, 0, 4]), np.array([1, 1, 1, 0, 0, 1, 0, 0], bool)
    tree = attention.build_tree(counts, starts)
    p = {k: v.astype(np.float64) for k, v in attention.initial(tree).items()}
    p["U"] = rng.standard_normal(p["U"].shape) * 0.3
    shape = (3, attention.WINDOW)
    args = rng.integers(0, len(tree.depth) + 1, shape), rng.integers(0, len(tree.depth), shape), rng.random(shape) < 0.9
    g, _ = attention.gradient(p, tree, *args)
    for name in p:
        i = tuple(int(rng.integers(0, s)) for s in p[name].shape)
        old = p[name][i]
        p[name][i] = old + 1e-5
        up = attention.gradient(p, tree, *args)[1]
        p[name][i] = old - 1e-5
        down = attention.gradient(p, tree, *args)[1]
        p[name][i] = old
        assert math.isclose(g[name][i], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-8), name
    h = rng.standard_normal((1, attention.WIDTH))
    bits = [sum(x[0] for x in attention.tree_bits(p, tree, h, tree.leaf_of[[i]])) + tree.other_bits[i] for i in range(8)]
    assert math.isclose(sum(2.0 ** -b for b in bits), 1, rel_tol=1e-5)


def test_windows_score_each_token_once_and_causally():
    tree = attention.build_tree(np.arange(1, 30), np.arange(29) % 2 == 0)
    p = attention.initial(tree)
    rng = np.random.default_rng(1)
    p["U"] = rng.standard_normal(p["U"].shape).astype(np.float32) * 0.2
    seq = rng.integers(0, 29, 200)
    off = np.array([0, 3, 3 + 70, 200])
    leaf = tree.leaf_of[seq]
    a = np.add(*attention.sequence_bits(p, tree, leaf, off))
    assert (a > 0).all()
    changed = leaf.copy()
    changed[150] = (changed[150] + 1) % 29          # later tokens don't change earlier scores
    b = np.add(*attention.sequence_bits(p, tree, changed, off))
    assert np.allclose(a[:150], b[:150], atol=1e-5) and not np.allclose(a[150:], b[150:], atol=1e-5)
    alone = np.add(*attention.sequence_bits(p, tree, leaf[3:73], np.array([0, 70])))
    assert np.allclose(a[3:73], alone, atol=1e-4)   # other sequences don't matter


def test_lm_base_and_gain(spark, docs):
    rows = {r["doc_id"]: r for r in op3_lm.op3_lm(spark, SF).collect()}
    words = {d: WORD.findall((t or "").encode().translate(LOW)) + [b"\n"] for d, t in docs}
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, x in words.items() if not out(d) for w in x)
    n, v = sum(c.values()), len(c)
    for d, x in words.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(d), len(x), sum(w in c for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        assert r["score"] < 0
    train = [r for r in rows.values() if not r["held_out"]]
    assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)


def test_lm_trains_on_every_run(spark, monkeypatch):
    """A round takes all runs of all documents, also of a table of over 1.6 million words."""
    steps = []
    monkeypatch.setattr(op3_lm, "ROUNDS", 1)
    monkeypatch.setattr(op3_lm, "averaged",
                        lambda rows, like: steps.append(rows.where("chunk = 0").agg({"weight": "sum"}).first()[0]) or like)
    docs = spark.createDataFrame([(i, "a b c d e f g h i j " * 1000) for i in range(162)], "doc_id long, text string")
    op3_lm.train(docs.coalesce(1), op3_lm.default_ranks())
    windows = 162 * -(-10_001 // attention.WINDOW)          # each word is a subword, and the end
    assert len(steps) == 1 and abs(steps[0] - windows / op3_lm.STEP_WINDOWS) <= 4     # a step may join two chunks' rests


def test_lm_windows_have_each_subword_as_target_once():
    path = op3_lm.default_ranks()
    enc = op3_lm.rank_encoder(path)
    tree = attention.build_tree(np.ones(enc.vocab_size + 1, np.int64), np.append(enc.begins, True))
    texts = ["qzxvkj" * 60 + " " + " ".join(f"zq{i}xv{i * 7919}" for i in range(25)), "", "one two", None, "a " * 200]
    tokens, target, valid = op3_lm.runs(path, tree, *column(texts))
    seq, seq_off, *_ = op3_lm.sequences(path, *column(texts))
    leaf = tree.leaf_of[seq]
    assert target[valid].tolist() == leaf.tolist()
    begins = np.zeros(len(seq), bool)
    begins[seq_off[:-1]] = True
    assert tokens[valid].tolist() == np.where(begins, len(tree.depth), np.roll(leaf, 1)).tolist()


# ---- 4 Jaccard --------------------------------------------------------------------------------

def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().translate(LOW))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    ids = {}
    for (d, _), x in zip(rows, label):
        ids[x] = min(ids.get(x, d), d)
    return [(d, len(s), ids[x]) for (d, _), s, x in zip(rows, sets, label)]


def near_copies(rng, groups, most):
    """Groups of texts at many similarities around the bound, with shared passages and short texts."""
    vocab = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(12)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 4, 6, 30, 80, 150]))]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if rng.random() < 0.5 and len(w) > 1:
                    del w[rng.randrange(len(w))]
                else:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = passage + w
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_jaccard_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(op4_jaccard, "BLOCK", block)       # 4: groups in several blocks and block pairs
    rows = near_copies(random.Random(seed), 40, 12)
    rule = op4_jaccard.Rule(4, 85, 100)
    got = op4_jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), rule)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == \
        sorted(brute_components(rows, 4, 85, 100))


def test_jaccard_null_ids_dont_name_components(spark):
    words = [f"w{i}" for i in range(40)]
    text, near, other = " ".join(words), " ".join(words + ["x"]), "some other words that stand alone"
    rows = [(None, text), (5, text), (9, near), (None, near), (None, other), (7, other), (None, "only here and null for all")]
    got = op4_jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), op4_jaccard.Rule(4, 85, 100))
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == \
        {(None, 5): 2, (5, 5): 1, (9, 5): 1, (None, 7): 1, (7, 7): 1, (None, None): 1}


def test_block_links_span_all_links():
    rng = random.Random(9)
    rows = [(i, t) for i, t in near_copies(rng, 12, 14)]
    raw, off = column([t for _, t in rows])
    with np.errstate(over="ignore"):
        sets = op4_jaccard.shingle_sets(raw, off, 4)
    rule = op4_jaccard.Rule()
    links = list(op4_jaccard.block_links(np.arange(len(sets)), sets, rule))
    label = list(range(len(sets)))
    for a, b in links:
        assert len(np.intersect1d(sets[a], sets[b])) * 100 >= 85 * len(np.union1d(sets[a], sets[b]))
        x, y = label[a], label[b]
        label = [x if z == y else z for z in label]
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) * 100 >= 85 * len(np.union1d(sets[i], sets[j])):
                assert label[i] == label[j]


def test_second_pass_hands_on_nodes_not_pairs():
    """A meeting of 60 near sets, each a component of its own, hands on 60 rows (not 1,770 pairs) that hold every link."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 63, 100).astype(np.uint64)
    sets = [np.sort(np.append(base, rng.integers(1, 1 << 63, 3).astype(np.uint64))) for _ in range(60)]
    n, names = len(sets), ["token", "low", "high", "block", "node", "comp", "n", "map", "least"]
    ints = [np.full(n, int(base.min())), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.arange(n), np.arange(n),
            np.array([len(x) for x in sets])]
    arrays = [pa.array(x, pa.int64()) for x in ints] + [pa.array([op4_jaccard.bitmap(x) for x in sets], pa.binary()), pa.array(ints[0], pa.int64())]
    rule = op4_jaccard.Rule()
    met = pa.Table.from_batches(op4_jaccard._second_pass(rule)([pa.RecordBatch.from_arrays(arrays, names=names)]))
    assert met.num_rows == n and sorted(met["node"].to_pylist()) == list(range(n)) and len(set(met["meeting"].to_pylist())) == 1
    tokens = pa.array([sets[i].tobytes() for i in met["node"].to_pylist()], pa.binary())
    links = pa.Table.from_batches(op4_jaccard._verify(rule)(met.append_column("tokens", tokens).to_batches()))
    assert links.num_rows == n - 1 and set(links["a"].to_pylist()) | set(links["b"].to_pylist()) == set(range(n))
    # nodes of one component are not handed on again
    arrays[5] = pa.array(np.zeros(n, int), pa.int64())
    assert not list(op4_jaccard._second_pass(rule)([pa.RecordBatch.from_arrays(arrays, names=names)]))


def test_jaccard_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (4, "another text of its own, with more words"), (7, None), (8, "")]
    out = op4_jaccard.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(3, text), (4, rows[4][1]), (7, ""), (8, "")]


def test_jaccard_groups_are_the_same_in_any_order_of_tokens(spark, monkeypatch):
    """The tokens that a sample puts last change the work only."""
    rng = random.Random(12)
    base = [[rng.choice("abcdefghijklmnop") * 2 + str(rng.randint(0, 40)) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = "other" + str(rng.randint(0, 5))
        rows.append((i, " ".join(["a shared line of many texts"] * (i % 2) + w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    rule, found = op4_jaccard.Rule(), []
    sets = op4_jaccard.shingle_sets(*column([t for _, t in rows]), rule.k)
    tokens = np.unique(np.concatenate(sets))
    for last in (op4_jaccard.frequent_tokens, lambda *_: tokens[:0], lambda *_: tokens[::3]):
        monkeypatch.setattr(op4_jaccard, "frequent_tokens", last)
        found.append({r["doc_id"]: r["component_id"] for r in op4_jaccard.jaccard_groups(d, rule).collect()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(rows))}
    assert 12 <= len(set(want.values())) < len(rows) and found == [want] * 3


# ---- 5 mixing ---------------------------------------------------------------------------------

def test_targets_reshare_excess():
    mix = op5_mix.Mix()
    t = op5_mix.targets([100, 1000, 10, 500], mix)
    assert math.isclose(sum(t), 1.5 * 1610) and all(x <= 2 * n + 1e-9 for x, n in zip(t, [100, 1000, 10, 500]))
    assert t[0] == 200 and t[2] == 20       # capped; the rest by weight 2 : 5
    assert math.isclose(t[1] / t[3], 2 / 5) or t[3] == 1000


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 64, 1000):
        i = np.arange(n)
        p = op5_mix.permute(i, np.full(n, n), np.full(n, 77))
        assert sorted(p.tolist()) == i.tolist()


def test_mix_takes_near_targets_and_reruns_agree(spark):
    rows = op5_mix.op5_mix(spark, SF).collect()
    again = op5_mix.op5_mix(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += r["size"]
        s[3] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for size, source_size, target, taken in by.values():
        assert size == source_size and abs(taken - target) <= 2 * op5_mix.Mix().block_words


def test_mixed_texts_have_the_taken_words(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in op5_mix.op5_mix(spark, SF).collect()}
    words = Counter()
    for r in op5_mix.mix_texts(d).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"].encode()))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_every_slot_is_drawn_once(spark):
    mix = op5_mix.Mix(shard_blocks=16)
    sizes, goals = [640, 6400, 100], [1280.0, 3200.0, 50.0]
    slots = op5_mix.plan_slots(spark, ["a", "b", None], sizes, goals, mix).collect()
    by = Counter(r["sid"] for r in slots)
    assert by == {i: op5_mix.quota_slots(n, t, 64) for i, (n, t) in enumerate(zip(sizes, goals))}
    assert len({(r["sid"], r["slot"]) for r in slots}) == len(slots)
    assert max(Counter((r["sid"], r["block"]) for r in slots).values()) <= 2


# ---- 6 perplexity -----------------------------------------------------------------------------

def test_base_counts_brute_force(docs):
    texts = [t for _, t in docs] + ["a\n\na\n a\nb\na", "x " * 40, "", None, "é #*$%&|<> é\n\n\n"]
    got = np.array(op6_perplexity.base_counts(*column(texts))).T
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for t, row in zip(texts, got.tolist()):
        t = t or ""
        w = word.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert row == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]


def test_kneser_ney_sums_to_one_and_prefers_its_language(spark):
    rows = [(1, "en", "the cat sat on the mat and the dog sat too " * 3), (2, "de", "der hund und die katze sind im haus " * 3)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = op6_perplexity.Model.load(op6_perplexity.estimate(op6_perplexity.count_grams(d), min_share=0))
    for context in (b"\0\0\0 ", b" the", b"\0\0 t", b"zzzz", b"at a"):
        base = int.from_bytes(context, "big") << 8
        total = np.exp2(model.log2((0 << 40) | (base + np.arange(257) % 256 + 0))).tolist()
        assert 0.9 <= sum(total[:256]) <= 1.0001
    own = op6_perplexity.bits_per_word(model, *column(["the dog sat on the mat"] * 2), ["en", "de"])
    assert own[0] < own[1]


@pytest.mark.parametrize("min_share", [op6_perplexity.MIN_SHARE, 0.002, 0.02])
def test_kneser_ney_sums_to_one_after_the_cut(spark, min_share):
    """What n-grams left to back-off had is covered by their context's weight."""
    rng = random.Random(4)
    text = " ".join("th" + "".join(rng.choice("aaaabcde") for _ in range(rng.randint(2, 5))) for _ in range(600))
    d = spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string")
    grams = op6_perplexity.count_grams(d).cache()
    model = op6_perplexity.Model.load(op6_perplexity.estimate(grams, min_share=min_share))
    whole = op6_perplexity.Model.load(op6_perplexity.estimate(grams, min_share=0))
    for context in (b"\0\0 t", b"\0 th", b" tha", b"thaa", b"aaaa", b"haab", b"\0\0\0 "):
        grams_ = (int.from_bytes(context, "big") << 8) + np.arange(256)
        total, all_ = np.exp2(model.log2(grams_)).sum(), np.exp2(whole.log2(grams_)).sum()
        assert math.isclose(total, all_, abs_tol=0.01) and total > 0.98, (context, total, all_)


def test_perplexity_bands_reject_junk_and_keep_prose(spark):
    rows = [(r["doc_id"], r["kept"], r["base_failed"], r["n_symbols"], r["n_words"])
            for r in op6_perplexity.op6_perplexity(spark, "/root/testdata/sf0.01").collect()]
    clean = [k for _, k, failed, s, n in rows if not failed and s < n / 10]
    junk = [k for _, k, failed, s, n in rows if not failed and s > 2 * n]      # symbols after every word
    assert np.mean(clean) > 0.98 and junk and np.mean(junk) < 0.1
    assert not any(k for _, k, failed, _, _ in rows if failed)


@pytest.mark.parametrize("held", [op6_perplexity.HELD_GRAMS, 6, 0])
def test_perplexity_leaves_no_rare_gram_out(spark, monkeypatch, held):
    """Bits of the whole model, beside millions of common n-grams, whether the tasks hold the n-grams or join them."""
    monkeypatch.setattr(op6_perplexity, "HELD_GRAMS", held)
    rng = random.Random(9)
    rare = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(6)]
    rows = [(1, "en", "tell " * 1_200_000)] + [(i, "en", t) for i, t in enumerate(rare, 2)]
    rows += [(2, "en", rare[0]), (8, None, "seul ici " * 12), (None, "en", rare[1] + " zzz"), (9, "en", None), (10, "de", "")]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = op6_perplexity.perplexity_rules(d, trim=1.0).select("doc_id", "lang", "n_words", "bits").collect()
    whole = op6_perplexity.Model.load(op6_perplexity.estimate(op6_perplexity.count_grams(d), min_share=0))
    bits = op6_perplexity.bits_per_word(whole, *column([t for _, _, t in rows]), [x for _, x, _ in rows])
    want = sorted(((i or 0, lang or "", len((t or "").split())), b) for (i, lang, t), b in zip(rows, bits.tolist()))
    got = sorted(((r["doc_id"] or 0, r["lang"] or "", r["n_words"]), r["bits"]) for r in got)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([b for _, b in got], [b for _, b in want], rtol=1e-5, atol=1e-9)


def test_second_model_is_that_of_the_documents_within_the_limit(spark, monkeypatch):
    """Counts less those beyond the limit, n-grams of theirs alone by back-off, as a model of the others would say."""
    monkeypatch.setattr(op6_perplexity, "HELD_GRAMS", 40)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = [(i, "en", " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    rows += [(20, "en", " ".join("".join(rng.choice("#%&xyz7") for _ in range(7)) for _ in range(40)))] * 2
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r["bits"] for r in op6_perplexity.perplexity_rules(d).collect()}
    first = op6_perplexity.Model.load(op6_perplexity.estimate(op6_perplexity.count_grams(d)))
    texts, langs = column([t for _, _, t in rows]), ["en"] * len(rows)
    bits = op6_perplexity.bits_per_word(first, *texts, langs)
    limit = sorted(bits)[math.ceil(op6_perplexity.TRIM * len(bits)) - 1]
    within = [r for r, b in zip(rows, bits) if b <= limit + 1e-6]
    assert 0 < len(within) < len(rows) and all(i < 20 for i, _, _ in within)
    second = op6_perplexity.Model.load(op6_perplexity.estimate(op6_perplexity.count_grams(spark.createDataFrame(within, d.schema))))
    want = op6_perplexity.bits_per_word(second, *texts, langs)
    assert all(math.isclose(got[i], b, rel_tol=1e-5) for (i, _, _), b in zip(rows, want))


# ---- 7 decontamination ------------------------------------------------------------------------

def edit_distance_infix(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_decontamination_matches_brute_force(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcde ") for _ in range(rng.randint(60, 120))).strip()
    body = list(item)
    for _ in range(rng.randint(0, 9)):
        p = rng.randrange(len(body))
        body[p:p + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
    text = " ".join(["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 200))), "".join(body), "tail"])
    index = op7_decontaminate.build_index([(7, item)])
    raw, off = column([text])
    norm = textops.normalise(raw, off)[0].tobytes()
    best = edit_distance_infix(index.texts[0], norm)
    found = op7_decontaminate._finder([index])()(raw, off)[0].to_pylist()[0]
    assert bool(found) == (best <= index.budget[0])
    if found:
        assert min(f["edits"] for f in found) == best


def test_decontamination_blocks_and_offsets(spark):
    items = [(i, " ".join(f"it{i}w{j}" for j in range(20))) for i in range(5)]
    docs = [(1, "Größe vor " + items[3][1].upper() + "! danach"), (2, "nothing of it here"), (3, items[0][1] + " " + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (op7_decontaminate.BLOCK_BYTES, 200):         # one pass, and one pass an item
        rows = {r["doc_id"]: r["matches"] for r in op7_decontaminate.find_matches(d, b, block_bytes=block).collect()}
        assert {k: sorted(m["item_id"] for m in v) for k, v in rows.items()} == {1: [3], 2: [], 3: [0, 4]}
        m = rows[1][0]
        assert docs[0][1][m["start"]:m["end"]].lower() == items[3][1]


# ---- 8 licences -------------------------------------------------------------------------------

def test_licences(spark):
    mit = ["# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
           "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."]
    docs = [(1, "\n".join(mit)), (2, "\n".join(mit[::-1])), (3, "Text. Released under the MIT License."),
            (4, "Licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: GPL-3.0-only"), (None, "Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["licences"] for r in op8_licenses.licences(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["MIT"], 4: ["CC-BY-NC-4.0", "GPL-3.0-only"], None: ["Apache-2.0"]}


MIT_WRAPPED = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD_WRAPPED = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer
{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """{2} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_WRAPPED = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
ISC_WRAPPED = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
UNLICENSE_WRAPPED = """This is free and unencumbered software released into the public
domain."""
MPL_WRAPPED = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy"""


def test_licences_wrapped_and_commented(spark):
    marks = {"plain": "", "slash": "// ", "hash": "# ", "star": " * ", "dash": "-- ", "dnl": "dnl "}
    texts = {"MIT": MIT_WRAPPED, "Apache-2.0": APACHE_WRAPPED, "ISC": ISC_WRAPPED, "Unlicense": UNLICENSE_WRAPPED,
             "MPL-2.0": MPL_WRAPPED, "BSD-2-Clause": BSD_WRAPPED.format("1.", "2."),
             "BSD-3-Clause": (BSD_WRAPPED + ENDORSE).format("(a)", "(b)", "(c)")}
    docs, want = [], {}
    for name, text in texts.items():
        for mark in marks.values():
            for end in ("\n", "\r\n"):
                body = end.join((mark + line).rstrip() for line in text.split("\n"))
                docs.append((len(docs), f"x = 1{end}{end}/*{end}{body}{end}{end}*/"))
                want[len(docs) - 1] = [name]
    docs.append((len(docs), "Released under the MIT License\nCopyright 2020 Some One\nSPDX-License-Identifier: ISC\nmore"))
    want[len(docs) - 1] = ["ISC", "MIT"]
    got = {r["doc_id"]: r["licences"] for r in op8_licenses.licences(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


# ---- 9 token files ----------------------------------------------------------------------------

@given(st.lists(st.integers(0, 2**31 - 1), max_size=60), st.integers(1, 31))
@settings(max_examples=150, deadline=None)
def test_pack_round_trip(ids, width):
    a = np.array(ids, np.int64) % (1 << width)
    payload = op9_token_file.pack(a, width)
    assert op9_token_file.unpack(payload, len(a), width).tolist() == a.tolist()
    for start in range(len(a)):
        assert op9_token_file.unpack(payload, 1, width, start).tolist() == [a[start]]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(default_tokenizer())


@given(st.lists(st.text(alphabet="ab1.!'s \n\t\x0b\x85\xa0 　é漢|<>", max_size=14), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(encoder, texts):
    texts = texts + ["a<|endoftext|> b.", "can't  stop\n\n now,"]
    ids, n = encoder.encode_texts(texts)
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at:at + k].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        at += k


def test_token_file_digest_and_range(spark, docs, tmp_dir, encoder):
    op9_token_file.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), f"{tmp_dir}/t", block_ids=5000)
    rows = {r["doc_id"]: r for r in op9_token_file.digest(spark, f"{tmp_dir}/t").collect()}
    start, all_ids = 0, []
    for d, t in sorted(docs):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (rows[d]["start"], rows[d]["n_tokens"]) == (start, len(ids))
        assert rows[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        all_ids += ids
    got = sorted(tuple(r) for r in op9_token_file.read_range(spark, f"{tmp_dir}/t", 4321, 3000).collect())
    assert got == [(i, all_ids[i]) for i in range(4321, 7321)]


# ---- 10 quotations ----------------------------------------------------------------------------

def test_quotation_links(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine, thanks."),
            (1, 2, "user", "Other topic"), (1, 3, "assistant", "On Monday X wrote:\n> Fine,  THANKS\n>> How are you?\nGood."),
            (1, 4, "user", "> never said\nhm"), (1, 4, "user", "> never said\nhm"), (2, 0, None, None),
            (None, 1, "a", "> Hello there."), (2, 1, "user", "> Fine, thanks.\nother conversation")]
    out = op10_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["turn"]): (r["text"], r["reply_to"], r["thread_root"], r["thread_depth"]) for r in out}
    assert len(out) == len(rows)
    assert got[(1, 1)] == ("Fine, thanks.", 0, 0, 1) and got[(1, 3)] == ("Good.", 1, 0, 2)
    assert got[(1, 2)] == ("Other topic", None, 2, 0) and got[(1, 4)] == ("hm", None, 4, 0)
    assert got[(2, 1)][1] is None and got[(2, 0)][0] == "" and got[(None, 1)][1] is None


def test_long_reply_chain(spark):
    rows = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    out = op10_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["turn"], r["thread_root"], r["thread_depth"]) for r in out} == {(i, 0, i) for i in range(70)}
