"""Table access and intermediate tables of the llm operators."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm import textops
from tokentally.session import scratch_dir


def ship(spark: SparkSession) -> None:
    """Give the package's code to the session's Python workers (once a session)."""
    context = spark.sparkContext
    if getattr(context, "_tokentally_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tokentally-code-"), "tokentally_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tokentally")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    context._tokentally_shipped = True


def shipped(query: Callable) -> Callable:
    """A query or stage that first ships the package's code."""
    @functools.wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return query(spark, *rest)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(docs: DataFrame, fields: dict[str, str], make: Callable[[], Callable], text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with new columns computed from the whole texts in ``mapInArrow`` tasks.

    ``make()`` runs once a task and returns a function (bytes, offsets) -> one
    Arrow array per field.  A column of ``docs`` that has a new field's name is replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in fields]
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                       *([] if text in names else [F.col(f"`{text}`").alias("c_text")]))
    text_at = f"c{names.index(text)}" if text in names else "c_text"
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    schema = ", ".join([f"c{i} {kinds[f'c{i}']}" for i in range(len(names))]
                       + [f"n{i} {kind}" for i, kind in enumerate(fields.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in textops.chunks(batches, text_at):
            new = compute(*textops.utf8(batch.column(text_at)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f"c{i}") for i in range(len(names))] + list(new),
                names=[f"c{i}" for i in range(len(names))] + [f"n{i}" for i in range(len(fields))])

    done = sent.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
                       *[F.col(f"n{i}").alias(c) for i, c in enumerate(fields)])
