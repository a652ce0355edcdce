"""Per-stage task balance of every report on a hot-key variant of the data.

    python tools/skew_check.py [sf_dir] [report ...]
    CREASE_NO_BROADCAST=1 python tools/skew_check.py ...   # shuffled joins only

The deliveries of ``sf_dir`` are rewritten so that a third of all balls
belong to one match and innings, and a third are faced by one batter
(``skewed``).  Every report runs with Spark's event log written to a fresh
scratch folder; the log's task-end events give the records each task read
(scan input + shuffle input).  For each report the stage with the worst
balance is printed: max task records / mean task records over the tasks
that read anything, and the share of all the stage's records in its largest
task (stages under 1000 records are ignored).  A plan that gathers a hot key into one task shows a share near 1/3
or more.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from crease.sources.adapter import Tables, from_tpch  # noqa: E402


def skewed(tables: Tables) -> Tables:
    """A third of the balls moved into match 0 / innings 1, faced by batter B0."""
    d = tables.deliveries
    hot = ((F.col("ball") + F.col("over") + F.col("match_id")) % 3) == 0
    d = d.withColumns({
        "match_id": F.when(hot, F.lit(0)).otherwise(F.col("match_id")),
        "inning": F.when(hot, F.lit(1)).otherwise(F.col("inning")),
        "batter": F.when(hot, F.lit("B0")).otherwise(F.col("batter")),
    })
    return Tables(d, tables.matches)


def stage_balance(log_dir: str) -> dict[str, list[tuple]]:
    """report -> [(stage, tasks, total_records, max_task_records)] from the event log."""
    stage_job = {}
    tasks = defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description", "")
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    rec = (m.get("Input Metrics", {}).get("Records Read", 0)
                           + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
                    tasks[ev["Stage ID"]].append(rec)
    out = defaultdict(list)
    for sid, recs in tasks.items():
        desc = stage_job.get(sid, "")
        busy = [r for r in recs if r > 0]
        if desc and busy:
            out[desc].append((sid, len(busy), sum(busy), max(busy)))
    return out


MIN_RECORDS = 1000


def main() -> None:
    from crease.plans.catalog import QUERIES
    from crease.session import local_session

    from crease.plans import cleaning

    # Not a registered report: the single-pass running score, for contrast.
    extra = {"running_score[single_pass]": lambda t: cleaning.with_running_score(
        cleaning.legal_deliveries(t.deliveries), skew_safe=False)}
    reports = {**QUERIES, **extra}
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(reports)
    log_dir = tempfile.mkdtemp(prefix="crease-eventlog-")
    spark = local_session(**{"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                             "spark.eventLog.compress": "false",
                             "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    if os.environ.get("CREASE_NO_BROADCAST"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    tables = skewed(from_tpch(spark, sf))
    for name in names:
        spark.sparkContext.setJobDescription(name)
        reports[name](tables).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription(None)
    spark.stop()
    bal = stage_balance(log_dir)
    print(f"event log: {log_dir}")
    print(f"{'report':28s} {'worst stage':>11s} {'tasks':>5s} {'records':>9s} {'max task':>9s} {'max/mean':>8s} {'share':>6s}")
    for name in names:
        stages = [s for s in bal.get(name, []) if s[1] > 1 and s[2] >= MIN_RECORDS]
        if not stages:
            print(f"{name:28s} (no multi-task stage with >= {MIN_RECORDS} records)")
            continue
        sid, n, tot, mx = max(stages, key=lambda s: s[3] / (s[2] / s[1]))
        print(f"{name:28s} {sid:11d} {n:5d} {tot:9d} {mx:9d} {mx / (tot / n):8.2f} {mx / tot:6.2f}")


if __name__ == "__main__":
    main()
