"""Every document operator on nulls, empty and very long texts, repeats, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokentally.llm import op2_toxicity, op4_jaccard, op5_mix, op7_decontaminate, op9_token_file
from tokentally.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = ([(1, 1, 0), (None, 0, 1), (3, None, None), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
BENCH = ([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "short")], "item_id long, text string")
DOC_QUERIES = ["op2_toxicity", "op3_lm", "op4_jaccard", "op5_mix", "op6_perplexity", "op7_decontaminate", "op8_licenses",
               "op9_token_file"]


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_odd_rows(spark, write_tables, odd_docs, name):
    d = write_tables(documents=(odd_docs, DOCS), labels=LABELS, benchmark=BENCH)
    rows = QUERIES[name](spark, d).collect()
    assert len(rows) == len(odd_docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(
        (r[0] is None, r[0] or 0) for r in odd_docs)


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_empty_table(spark, write_tables, name):
    d = write_tables(documents=([], DOCS), labels=([], LABELS[1]), benchmark=([], BENCH[1]))
    assert QUERIES[name](spark, d).collect() == []


def test_pages_and_conversations_empty(spark, write_tables):
    d = write_tables(pages=([], "page_id long, url string, html string"),
                     conversations=([], "conv_id long, turn long, role string, text string"))
    assert QUERIES["op1_html"](spark, d).collect() == []
    assert QUERIES["op10_quotes"](spark, d).collect() == []


STAGES = {"toxicity": op2_toxicity, "jaccard": op4_jaccard, "decontamination": op7_decontaminate, "mix": op5_mix}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_keeps_columns_with_clashing_names(spark, write_tables, odd_docs, name):
    d = write_tables(documents=(odd_docs, DOCS), labels=LABELS, benchmark=BENCH)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for c in ("score", "toxicity_score", "benchmark_matches", "matches", "size", "taken", "node", "th", "bucket", "dup", "source_size"):
        docs = docs.withColumn(c, F.lit(1))
    out = STAGES[name].stage(spark, docs, d)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert out.count() > 0


def test_token_file_stage(spark, write_tables, odd_docs):
    d = write_tables(documents=(odd_docs, DOCS), labels=LABELS, benchmark=BENCH)
    assert op9_token_file.stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() == len(odd_docs)


def test_pipeline_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    from tokentally.llm.sources import materialize
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"t-{name}")
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, sf).collect())
