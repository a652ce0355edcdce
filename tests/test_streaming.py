"""Streaming ingest appends each landed file exactly once."""

from __future__ import annotations

import os
import tempfile

from crease.plans import leaderboards as lb
from crease.sources.schemas import DELIVERIES_SCHEMA, DELIVERY_COLUMNS
from crease.streaming.ingest import ingest

HEADER = ",".join(DELIVERY_COLUMNS)


def _land(folder, name, lines):
    with open(os.path.join(folder, name), "w") as f:
        f.write(HEADER + "\n" + "\n".join(lines) + "\n")


def test_ingest_is_incremental_and_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="crease-stream-")
    landing, table, ckpt = f"{root}/landing", f"{root}/table", f"{root}/ckpt"
    os.makedirs(landing)
    _land(landing, "m1.csv", ["1,1,A,B,0,1,P,X,N,6,0,6,NA,0,NA,NA,NA", "1,1,A,B,0,2,P,X,N,4,0,4,,0,,,"])
    q = ingest(spark, landing, table, checkpoint=ckpt)
    q.awaitTermination(120)
    assert spark.read.schema(DELIVERIES_SCHEMA).parquet(table).count() == 2

    _land(landing, "m2.csv", ["2,1,A,B,0,1,Q,X,N,6,0,6,,0,,,"])
    q = ingest(spark, landing, table, checkpoint=ckpt)       # restart from the checkpoint
    q.awaitTermination(120)
    t = spark.read.schema(DELIVERIES_SCHEMA).parquet(table)
    assert t.count() == 3
    assert t.where("extras_type IS NULL").count() == 3
    assert sorted((r.batter, r.Sixes_Hit) for r in lb.top_sixes(t).collect()) == [("P", 1), ("Q", 1)]


def test_default_checkpoint_belongs_to_the_table(spark):
    root = tempfile.mkdtemp(prefix="crease-stream-")
    for k in ("a", "b"):
        os.makedirs(f"{root}/{k}")
        _land(f"{root}/{k}", "m.csv", [f"{k == 'b':d},1,A,B,0,1,P,X,N,6,0,6,NA,0,NA,NA,NA"])
    for _ in range(2):                                  # the second round is a restart with the same settings
        for k in ("a", "b"):
            ingest(spark, f"{root}/{k}", f"{root}/table-{k}").awaitTermination(120)
    for k in ("a", "b"):
        t = spark.read.schema(DELIVERIES_SCHEMA).parquet(f"{root}/table-{k}")
        assert [r.match_id for r in t.collect()] == [int(k == "b")]
