"""The sweep against single runs, and class reports and paired intervals on hand-made rows."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgraph.operators import diagnostics, metrics
from clipgraph.operators.probs import tune_tau
from clipgraph.plans import refine as plans


@pytest.fixture(scope="module")
def run(spark):
    rng = np.random.default_rng(3)
    label = [int(x) for x in rng.integers(0, 3, 40)]
    rows = [(i, i % 2, [float(x) for x in rng.normal(0, 1, 6) + 2.5 * np.eye(6)[label[i]]], [float(x) for x in rng.dirichlet(np.ones(3) + 2 * np.eye(3)[label[i]])],
             [float(x) for x in rng.dirichlet(np.ones(3) + np.eye(3)[label[i]])], label[i]) for i in range(40)]
    t = spark.createDataFrame(rows, "clip_id LONG, grp INT, f ARRAY<DOUBLE>, p ARRAY<DOUBLE>, v ARRAY<DOUBLE>, label INT")
    return t.select("clip_id", "grp", "f"), t.select("clip_id", "grp", "p"), t.select("clip_id", "grp", F.col("v").alias("p")), t.select("clip_id", "label")


def test_sweep_equals_single_runs_and_builds_each_graph_once(run):
    emb, probs, evidence, labels = run
    base, memo = {"drop": 1, "stages": (), "iters": 2, "k": 4}, plans.Memo()
    got = plans.sweep([(emb, probs, evidence)], labels, {"k": [6], "temp": [1.0, 2.0], "drop": [0], "g": [0.6]}, 3, base, memo=memo).collect()
    assert memo.made("graph") == len({(1, 4), (1, 6), (0, 4)} | ({(0, 6)} if any("k=6" in r["config"] and "drop=0" in r["config"] for r in got) else set()))
    by = {r["config"]: r for r in got}
    for name, change in (("current", {}), ("k=6", {"k": 6}), ("drop=0", {"drop": 0})):
        best = tune_tau(plans.refine(emb, probs, evidence, **{**base, **change}).select("clip_id", "p").join(labels, "clip_id"), 3).head()
        assert (by[name]["tau"], by[name]["f1"]) == pytest.approx((best["tau"], best["f1"]))
        assert by[name]["gain"] == pytest.approx(best["f1"] - by["current"]["f1"])
    helped = {r["config"].split("=")[0] for r in got if r["gain"] > 1e-12 and "+" not in r["config"]}
    assert sum("+" in r["config"] for r in got) == 2 ** len(helped) - 1 - len(helped)


def test_sweep_searches_once_for_all_k(run, monkeypatch):
    emb, probs, evidence, labels = run
    searched, search = [], plans.knn
    monkeypatch.setattr(plans, "knn", lambda df, by, k, **named: searched.append(k) or search(df, by, k, **named))
    base = {"drop": 1, "stages": (), "iters": 1, "k": 4}
    got = plans.sweep([(emb, probs, evidence)], labels, {"k": [6, 3]}, 3, base).collect()
    assert searched == [6] and {r["config"] for r in got} == {"current", "k=6", "k=3"}
    for name, k in (("current", 4), ("k=3", 3)):
        best = tune_tau(plans.refine(emb, probs, evidence, **{**base, "k": k}).select("clip_id", "p").join(labels, "clip_id"), 3).head()
        assert {r["config"]: (r["tau"], r["f1"]) for r in got}[name] == pytest.approx((best["tau"], best["f1"]))


def test_paired_bootstrap(spark):
    rows = [(c, g, y, y if c == "b" or g == 0 else 1 - y, 3) for c in ("a", "b") for g in range(4) for y in (0, 1)]
    conf = spark.createDataFrame(rows, "config STRING, grp INT, y INT, pred INT, n LONG")
    (r,) = metrics.bootstrap_paired(conf, "grp", 50, "config", [("a", "b")], 1).collect()
    assert (r["diff"], r["improved"], r["groups"]) == (pytest.approx(0.75), 3, 4)
    draws = metrics.bootstrap_draws(conf, "grp", 50, 1).where("grp = 0").collect()
    gains = [1 - k / 4 for k in [x["k"] for x in draws] + [0] * (50 - len(draws))]
    assert (r["lo"], r["hi"]) == (pytest.approx(np.quantile(gains, 0.025)), pytest.approx(np.quantile(gains, 0.975)))
    assert metrics.bootstrap_paired(conf.where("config = 'a'"), "grp", 5, "config", [("a", "b")], 1).head()["diff"] is None


def test_class_report_by_side(spark):
    rows = spark.createDataFrame([(0, 0, "arm"), (0, 1, "leg"), (1, 1, "arm"), (1, 1, None), (None, 1, "leg")], "label INT, pred INT, side STRING")
    got = {r["class"]: r for r in diagnostics.per_class_sides(rows, ["pred"], "side", ["arm", "leg"], 3).collect()}
    assert [(got[c]["recall_arm"], got[c]["recall_leg"]) for c in (0, 1, 2, None)] == [(1, 0), (1, 0), (0, 0), (pytest.approx(2 / 3), 0)]
    assert len(got) == 4 and got[2]["best"] == 0
