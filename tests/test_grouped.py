"""Models of all groups at once against a model of each group alone."""
from __future__ import annotations

import numpy as np
import pytest

from clipgraph.operators import grouped

D, C, RIDGE = 3, 4, 0.05


@pytest.mark.parametrize("block_rows", [4096, 10])
def test_each_group_has_its_own_model(spark, block_rows):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, n in ((0, 60), (1, 25), (2, 90), (3, 6)):
        x = rng.normal(size=(n, D))
        conf = rng.random((n, C)) + 1.5 * np.eye(C)[(x @ rng.normal(size=(D, C))).argmax(1)]
        p = conf / conf.sum(1, keepdims=True)
        ids = [1000 * g + i for i in range(n)]
        rows += [(i, g, a.tolist(), b.tolist()) for i, a, b in zip(ids, x, p)]
        sure = p.max(1) >= np.quantile(p.max(1), 0.4)
        y = p.argmax(1)
        done = sure.sum() >= 5 and len(set(y[sure])) >= 2
        want.update(zip(ids, p))
        if done:
            x1 = np.column_stack([x, np.ones(n)])
            w = np.zeros((C, D + 1))
            for _ in range(6000):
                e = grouped._softmax(x1[sure] @ w.T)
                e[np.arange(sure.sum()), y[sure]] -= 1
                grad = e.T @ x1[sure] / sure.sum()
                grad[:, :-1] += RIDGE * w[:, :-1]
                w -= 0.4 * grad
            want.update(zip(ids, 0.7 * p + 0.3 * grouped._softmax(x1 @ w.T)))
    df = spark.createDataFrame(rows, "clip_id long, grp int, f array<double>, p array<double>").repartition(3)
    out = grouped.self_train(df.drop("p"), df.select("clip_id", "p"), "f", 0.4, 0.3, C, ridge=RIDGE, min_rows=5, min_classes=2, tol=1e-5, block_rows=block_rows)
    got = {r["clip_id"]: r["p"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert max(np.abs(np.array(got[i]) - want[i]).max() for i in want) < 2e-3


def test_thresholds_can_be_off(spark):
    df = spark.createDataFrame([(1, 0, [0.1], [0.9, 0.1]), (2, 1, [0.3], [0.2, 0.8])], "clip_id long, grp int, f array<double>, p array<double>")
    same = {r["clip_id"]: r["p"] for r in grouped.self_train(df.drop("p"), df.select("clip_id", "p"), "f", 0.5, 0.5, 2).collect()}
    assert same == {1: [0.9, 0.1], 2: [0.2, 0.8]}
    every = grouped.self_train(df.drop("p"), df.select("clip_id", "p"), "f", 0.5, 0.5, 2, min_rows=None, min_classes=None, tol=1e-2).collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and r["p"] != same[r["clip_id"]] for r in every)
