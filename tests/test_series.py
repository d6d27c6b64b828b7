"""Series matched in blocks against all pairs, and balanced folds of many equal groups against the sequential rule."""
from __future__ import annotations

import numpy as np
import pytest

from clipgraph.operators import joins, ml


@pytest.mark.parametrize("chunk,block", [(1024, 256), (7, 2)])
def test_series_in_blocks(spark, chunk, block):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 60))
    a = {f"a{i}": {t: base[i, t] + 50 for t in range(60) if rng.random() < 0.9} for i in range(5)}
    b = {f"b{i}": {t: 2 * base[i, t] + rng.normal() for t in range(60) if rng.random() < 0.8} for i in range(5)}
    b["flat"] = {t: 3.0 for t in range(60)}
    frame = lambda d, n: spark.createDataFrame([(k, t, float(v)) for k, s in d.items() for t, v in s.items()] + [(n * 2, 3, None), (None, 3, 1.0)], f"{n} string, sec int, change double")
    got = {(r["a"], r["rank"]): (r["b"], r["r"], r["n"]) for r in joins.match_series(frame(a, "a"), frame(b, "b"), "a", "b", min_n=20, chunk=chunk, block=block).collect()}
    for x, s in a.items():
        found = []
        for y, u in b.items():
            t = sorted(s.keys() & u.keys())
            if len(t) > 20 and y != "flat":
                found.append((-np.corrcoef([s[i] for i in t], [u[i] for i in t])[0, 1], y, len(t)))
        for rank, (r, y, n) in enumerate(sorted(found)[:2], 1):
            assert got[x, rank][0] == y and got[x, rank][1] == pytest.approx(-r) and got[x, rank][2] == n
    assert len(got) == 10


@pytest.mark.parametrize("folds,seed", [(3, 1), (5, 2), (4, 3)])
def test_folds_follow_the_sequential_rule(spark, folds, seed):
    rng = np.random.default_rng(seed)
    sizes = [*rng.integers(1, 9, 60).tolist(), 40, 17]
    df = spark.createDataFrame([(g, i) for g, s in enumerate(sizes) for i in range(s)], "g int, i int")
    got = {r["g"]: r["fold"] for r in ml.group_kfold(df, "g", folds).collect()}
    load, count = [0] * folds, {}
    for s in sorted(sizes, reverse=True):
        f = load.index(min(load))
        load[f] += s
        count[s, f] = count.get((s, f), 0) + 1
    mine = {}
    for g, f in got.items():
        mine[sizes[g], f] = mine.get((sizes[g], f), 0) + 1
    assert mine == count
