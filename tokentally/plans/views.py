"""Combined views over the imported store and the live sink.

The metered tool keeps one fact table and one rollup for both sources; here
the live path (stream) and the import path (sync) write separate tables, and
these views put them back together for the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators.merge import upsert_monotone
from tokentally.sources.schemas import TOKEN_COLUMNS


def all_usage(store, sink=None) -> DataFrame:
    """Imported aggregate fact rows plus live fact rows (``tokens``), with a
    ``source`` column ('import' / 'live').  The same activity can appear in
    both (a live day session and the transcript imported later); reports use
    every row by default, as the metered tool does, and a user may filter.
    ``dt`` is a partition column of both, so a time-bounded report reads only
    the folders of its days."""
    t = store.tokens.read().select(*TOKEN_COLUMNS, "dt", F.lit("import").alias("source"))
    if sink is None:
        return t
    return t.unionByName(sink.facts().select(*TOKEN_COLUMNS, "dt", F.lit("live").alias("source")))


def all_chats(store, sink=None) -> DataFrame:
    """The rollup of both paths: the live rollup is folded into the imported
    one with the monotone policy, as a sync run folds the fact table."""
    c = store.chats.read()
    return c if sink is None else upsert_monotone(c, sink.rollup())
