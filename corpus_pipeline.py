"""The corpus pipeline: documents to packed token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tokentally.llm import op2_toxicity, op4_jaccard, op5_mix, op7_decontaminate, op9_token_file
from tokentally.llm.sources import materialize, shipped, table

STAGES = [
    ("toxicity", op2_toxicity.stage),
    ("near_duplicates", op4_jaccard.stage),
    ("decontamination", op7_decontaminate.stage),
    ("mix", op5_mix.stage),
    ("token_file", op9_token_file.stage),
]
#: Bytes of text that a stage hands to a Python worker at once.  Its 64 MB by default are held several times
#: over, by each worker of an executor.
BATCH_BYTES = 8 << 20


def bounded(stage):
    """A stage with small Arrow batches, unless the session has a size of its own."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(name).rstrip("b") == str(64 << 20):
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, bounded(shipped(stage))) for name, stage in STAGES]

#: No stage's method (compression, trees, alignment, permutations, packing) can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
