"""The live rollups as runs of mergeable rows.

A micro-batch adds its own rows (a delta a session; sums a bucket) as a run and
reads nothing back: what it writes follows the batch, not the number of
sessions.  Rows of a key merge in any order (``operators.merge``,
``operators.summary``), so a rollup is the merge of all runs.  Every ``FAN`` batches the last ``FAN`` runs become one, every ``FAN``
such runs one again, and so on: after n batches there are at most ``FAN`` runs
of each of log(n) sizes, and a row is rewritten log(n) times in all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tokentally.constants import HISTORY_KEEP, PERIODS
from tokentally.operators.history import history_last
from tokentally.operators.merge import fold_keyed
from tokentally.operators.summary import BUCKETS, DAYS, bucket_sums, day_sums, merge_sums, period_summary_from
from tokentally.sources.literal import empty_table
from tokentally.sources.schemas import CHAT_COLUMNS
from tokentally.sources.store import SnapshotTable

#: Runs of one size that are merged into one of the next.
FAN = 16


class Runs(SnapshotTable):
    """Snapshot table whose versions are lists of runs (one path each); ``merge`` makes one row a key."""

    fan = FAN

    def merge(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def add(self, delta: DataFrame, batch_id: int, stream: str = "") -> None:
        """Add a batch's rows (one row a key); nothing if the batch is there already."""
        if self.applied(batch_id, stream):
            return
        cur = self.current()
        runs = [] if cur is None else list(cur["paths"])
        nth, sizes = (0 if cur is None else cur["version"] + 1) + 1, 0
        while nth % self.fan == 0:          # this batch fills a run of the next size
            nth, sizes = nth // self.fan, sizes + 1
        kept = max(0, len(runs) - sizes * (self.fan - 1))
        if kept < len(runs):
            delta = self.merge(self._load(runs[kept:]).unionByName(delta))
        self._commit(delta, batch_id, runs[:kept], stream)

    def read(self) -> DataFrame:
        cur = self.current()
        return empty_table(self.spark, self.schema) if cur is None else self._load(cur["paths"])

    def _load(self, paths: list[str]) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        if not self.partition_by:
            return read.parquet(*paths)
        # folders of partitions have one root in a reader; there are few runs
        return reduce(DataFrame.unionByName, [read.parquet(p) for p in paths])

    def merged(self) -> DataFrame:
        return self.merge(self.read())


class RollupRuns(Runs):
    """Per-session deltas of the live policy."""

    def merge(self, rows: DataFrame) -> DataFrame:
        return fold_keyed(rows)

    def rollup(self) -> DataFrame:
        """One row a session, in the chats schema."""
        return self.merged().select(*CHAT_COLUMNS)


class RingRuns(Runs):
    """The last responses of each session: a run holds at most ``HISTORY_KEEP`` rows a session, and so does
    what a task hands on when runs are merged."""

    def merge(self, rows: DataFrame) -> DataFrame:
        return history_last(rows, HISTORY_KEEP, key="session").drop("pos")

    def rings(self) -> DataFrame:
        """(session, pos, ts, id, input, output), ``pos`` 0 the oldest of a session's ring."""
        return history_last(self.read(), HISTORY_KEEP, key="session")


class SumRuns(Runs):
    """Sums of the facts by day, model and bucket (or day)."""

    def merge(self, rows: DataFrame) -> DataFrame:
        return merge_sums(rows)


class UsageSummary:
    """Bucket and day sums under ``root``, added to by each batch of facts."""

    def __init__(self, spark: SparkSession, root: str):
        self.buckets = SumRuns(spark, f"{root}/buckets", BUCKETS, partition_by=["dt"])
        self.days = SumRuns(spark, f"{root}/days", DAYS)

    def add(self, facts: DataFrame, batch_id: int, stream: str = "") -> None:
        """Add a batch's facts; a replayed batch adds nothing, also when it died between the two tables."""
        sums = bucket_sums(facts)
        self.buckets.add(sums, batch_id, stream)
        self.days.add(day_sums(sums), batch_id, stream)

    def period_summary(self, facts: DataFrame, as_of: int, periods=PERIODS) -> DataFrame:
        """Equal to the report over all of ``facts`` (with ``dt``), of which it reads one bucket a period."""
        return period_summary_from(self.days.merged(), self.buckets.read(), facts, as_of, periods)
