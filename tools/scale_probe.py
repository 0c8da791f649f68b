"""Time heavy operators on events replicated k times (ids shifted), with a
third of all rows moved into one session.

usage: python tools/scale_probe.py [sf_dir] [k ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tokentally.constants import FIXTURE_AS_OF as AS_OF  # noqa: E402
from tokentally.operators.periods import period_summary  # noqa: E402
from tokentally.operators.running import session_running_cost  # noqa: E402
from tokentally.operators.series import usage_series  # noqa: E402
from tokentally.operators.sessions import cost_by_family, session_rollup  # noqa: E402
from tokentally.session import get_spark  # noqa: E402
from tokentally.sources.driver_tables import load_usage  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ks = [int(k) for k in sys.argv[2:]] or [1, 10, 20]
    spark = get_spark("local[8]", shuffle_partitions=16)
    base = load_usage(spark, sf)
    for k in ks:
        u = (base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rep"))
                 .withColumn("id", F.col("id") + F.col("rep") * 10**7)
                 .withColumn("session", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("session")))
                 .drop("rep").repartition(16))
        for name, df in [("periods", period_summary(u, AS_OF)), ("series", usage_series(u, AS_OF)),
                         ("rollup", session_rollup(u)), ("families", cost_by_family(u)),
                         ("running", session_running_cost(u))]:
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            print(f"x{k} {name} {time.perf_counter() - t0:.2f}s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
