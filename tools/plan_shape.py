"""Count fact scans, exchanges, broadcasts, joins and windows in every report's plan.

    python tools/plan_shape.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from crease.plans.catalog import QUERIES
    from crease.session import local_session
    from crease.sources.adapter import from_tpch
    from tests.plan_text import plan_text

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    for name, report in QUERIES.items():
        p = plan_text(report(from_tpch(spark, sf)), "simple")
        counts = {
            "lineitem_scans": len(re.findall(r"FileScan parquet \[l_", p)),
            "orders_scans": len(re.findall(r"FileScan parquet \[o_", p)),
            "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", p)),
            "broadcasts": len(re.findall(r"BroadcastExchange", p)),
            "smj": len(re.findall(r"SortMergeJoin", p)),
            "windows": len(re.findall(r"\bWindow \[", p)),
        }
        print(f"{name:28s} " + " ".join(f"{k}={v}" for k, v in counts.items()))
    spark.stop()


if __name__ == "__main__":
    main()
