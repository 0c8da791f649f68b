"""Write PLANS.md: operator counts of the final (AQE) plan of every batch query.

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokentally.catalog import QUERIES  # noqa: E402
from tokentally.session import get_spark  # noqa: E402

COUNT = [
    ("scans", r"FileScan parquet|Scan parquet"),
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange shufflepartitionid"),
    ("broadcasts", r"BroadcastExchange"),
    ("smj", r"SortMergeJoin"),
    ("bhj", r"BroadcastHashJoin"),
    ("windows", r"\bWindow \["),
    ("group_limit", r"WindowGroupLimit"),
    ("top_k", r"TakeOrderedAndProject"),
    ("sort_agg", r"SortAggregate"),
]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    rows = []
    for name, fn in QUERIES.items():
        if name.startswith("stream_"):
            continue
        df = fn(spark, sf)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = buf.getvalue()
        if "== Final Plan ==" in plan:      # count the executed plan only
            plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
        counts = [len(re.findall(p, plan)) for _, p in COUNT]
        schemas = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
        rows.append((name, counts, "; ".join(schemas)))
    head = "| query | " + " | ".join(c for c, _ in COUNT) + " | columns read |"
    sep = "|" + "---|" * (len(COUNT) + 2)
    lines = [head, sep] + [f"| {n} | " + " | ".join(map(str, c)) + f" | {s} |" for n, c, s in rows]
    text = f"""# Physical plans of the registered batch queries

Generated by `tools/plan_report.py` from the final adaptive plans at {os.path.basename(sf)}
(`local[8]`, 8 shuffle partitions). Counts are operators in the plan text; "shuffles" counts
exchanges of rows between tasks (partial aggregates included), "broadcasts" counts broadcast
exchanges, all of which are bounded by construction or by a checked row count.

""" + "\n".join(lines) + "\n"
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write(text)
    print(text)
    spark.stop()


if __name__ == "__main__":
    main()
