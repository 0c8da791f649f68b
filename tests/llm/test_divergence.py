"""The divergence audit against plain loops over exact whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tokentally.llm import op11_divergence as D
from tokentally.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, term string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least=3, top=200):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOW))) for r in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}

    def shares(count, lang):
        total, v = sum(count[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + v) for t in kept[lang]}
    p = {g: shares(c, g[0]) for g, c in counts.items()}
    out = []
    for (lang, source), own in p.items():
        whole = Counter()
        for g, c in counts.items():
            if g[0] == lang:
                whole.update(c)
        q = shares(whole, lang)
        pair = [(sum((own[t] - other[t]) ** 2 // other[t] for t in own), g[1])
                for g, other in p.items() if g[0] == lang and g[1] != source]
        term = [((own[t] - q[t]) ** 2 // q[t], t) for t in own if counts[lang, source][t] > 0 and own[t] > q[t]]
        for part, items, limit in (("pair", pair, None), ("term", term, top)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def random_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["a", "Ab", "abc", "abcd", "ABCDE", "abcdefgh", "abcdefghi", "abcdefghij" * 4, "ß", "ßß", "ñandú", "漢字" * 9, "x" * 700, "İ", "É",
                  "zz", "zzz", "zzzz", "zzzzz"] + [f"w{'qxyz'[i % 4]}{'abcdefg'[i % 7] * (i % 11)}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", "1", "\n", "_", "\x00", "@ "]) for w in words)
        rows.append((i, rng.choice([text, text, text, None, ""]) if i % 9 == 0 else text, rng.choice(["en", "de", None, ""]),
                     rng.choice(["s1", "s2", None, "s,4", "é5"]), "t", 1))
    return rows + rows[:6] + [(None, "abcd lonely", "en", "s1", None, None), (900, "once", "fr", "s1", "t", 1), (901, None, "fr", "s2", "t", 1)]


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"tile": 2, "bucket_rows": 40}), (3, {"least": 6, "top": 3})])
def test_audit_equals_plain_loops(spark, seed, how):
    rows = random_rows(seed)
    got = D.divergence(spark.createDataFrame(rows, DOCS).repartition(5), **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = expected(rows, how.get("least", 3), how.get("top", 200))
    assert any(len(r[3]) == 700 for r in want) or seed != 1
    assert sorted(map(tuple, got.collect())) == want


def test_query_on_very_long_texts_and_ties(spark, write_tables):
    long = " ".join("abcdefgh"[i % 8] * (1 + i % 50) for i in range(40_000))
    rows = [(i, long, "en", f"s{i % 2}", "", 0) for i in range(4)] + [(9, "solo", "en", "s0", "", 0)]
    d = write_tables(documents=(rows, DOCS))
    assert sorted(map(tuple, QUERIES["op11_divergence"](spark, d).collect())) == expected(rows)


def test_empty_table_and_no_kept_terms(spark, write_tables):
    d = write_tables(documents=([], DOCS))
    assert QUERIES["op11_divergence"](spark, d).collect() == []
    rows = [(1, "only here", "en", "a", "", 0), (2, None, "en", "b", "", 0)]
    got = D.divergence(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, got.collect())) == expected(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_kept_terms_equal_document_counts_with_a_crowded_bitmap(spark, monkeypatch):
    """False hits of the bitmap only cost counts: every bit set gives the same terms."""
    rows = random_rows(7)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text")
    plain = sorted(map(tuple, D.kept_terms(docs, 4, first=1).collect()))
    monkeypatch.setattr(D, "bitmap", lambda _: b"\xff" * (D.BITMAP_BITS // 8))
    assert sorted(map(tuple, D.kept_terms(docs, 4, first=1).collect())) == plain
    assert plain


def test_bitmap_holds_every_prefix(spark):
    rows = [(lang, bytes([i, 200, i])) for lang in ("", "en") for i in range(97, 122)]
    bits = D.bitmap(spark.createDataFrame(rows, "lang string, term binary"))
    langs, at = D._codes(pa.array([r[0] for r in rows]))
    for bit in D.hashes(langs, at, pa.array([r[1] for r in rows], pa.large_binary())):
        assert bits[bit >> 3] >> (bit & 7) & 1
    assert sum(b.bit_count() for b in bits) == len(rows)


def test_terms_end_where_texts_do():
    texts = ["ab", "cd ef", "", "É-x1y"]
    raw, off = D.textops.utf8(pa.array(texts))
    doc, terms, code = D.terms_of(raw, off)
    assert [(int(d), terms[int(c)].as_py().decode()) for d, c in zip(doc, code)] == [
        (0, "ab"), (1, "cd"), (1, "ef"), (3, "É"), (3, "x"), (3, "y")]
