"""Blocks of one dashboard agree with each other on the driver tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from core_helpers import AS_OF
from tokentally.operators.sessions import session_rollup
from tokentally.plans.dashboard import dashboard
from tokentally.sources.driver_tables import load_usage

SF = "/root/testdata/sf0.01"


def test_dashboard_blocks_agree(spark):
    u = load_usage(spark, SF)
    d = dashboard(u, AS_OF)
    per = {r["period"]: r for r in d.periods.collect()}
    fam = {r["family"]: r for r in d.families.collect()}
    rollup = session_rollup(u).agg(F.sum("msgs").alias("m"), F.sum("total_input").alias("i")).first()
    assert per["all"]["msgs"] == rollup["m"] == u.count()
    assert per["all"]["input"] == fam["total"]["input"] == rollup["i"]
    assert per["all"]["cost_cents"] == fam["total"]["cost_cents"]
    assert sum(r["cost_cents"] for k, r in fam.items() if k != "total") >= fam["total"]["cost_cents"] - 3
    series = {r["range"]: 0 for r in d.series.collect()}
    for r in d.series.collect():
        series[r["range"]] += r["input"]
    # every chart holds exactly the rows with  -width < as_of - ts < 30*width
    for label, w in (("1h", 120), ("24h", 2880), ("7d", 20160), ("30d", 86400)):
        want = u.filter((F.col("ts") > AS_OF - 30 * w) & (F.col("ts") < AS_OF + w)).agg(F.sum("input")).first()[0] or 0
        assert series[label] == want, label
    assert len(d.sessions.collect()) == 3


def _without_checkpoint_dir(spark, monkeypatch, local: bool):
    import tokentally.session as S
    conf = spark.conf
    real_get = conf.get
    monkeypatch.setattr(conf, "get", lambda k, d=None: None if k == "spark.checkpoint.dir" else real_get(k, d))
    monkeypatch.setattr(S, "_is_local", lambda s: local)
    return S


def test_cluster_without_checkpoint_dir_is_refused(spark, monkeypatch):
    S = _without_checkpoint_dir(spark, monkeypatch, local=False)
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    with pytest.raises(RuntimeError):
        S.checkpoint_root(spark)


def test_local_session_without_checkpoint_dir_gets_one(spark, monkeypatch):
    S = _without_checkpoint_dir(spark, monkeypatch, local=True)
    before = spark.sparkContext.getCheckpointDir()
    calls = []
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(spark.sparkContext, "setCheckpointDir", lambda d: calls.append(d))
    root = S.checkpoint_root(spark)
    assert calls == [root] and root.startswith(tempfile.gettempdir())
    assert before is not None
