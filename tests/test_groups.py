"""No row and no group may vanish: groups of one and two rows, groups without a basis, long shifts, ties, missing values."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipgraph.operators import knn, ordered, subspace, vectors

RNG = np.random.default_rng(8)
SIZES = {0: 1, 1: 2, 2: 12}
ROWS = [(i, g, RNG.normal(size=4).tolist(), i % 3) for i, g in enumerate([g for g, n in SIZES.items() for _ in range(n)])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "clip_id long, grp long, f array<double>, label int")


def by_id(out, c="f"):
    return {r["clip_id"]: r[c] for r in out.collect()}


@pytest.mark.parametrize("lo,hi", [(0, 2), (1, 3), (0, 4)])
def test_component_removal_keeps_every_row(df, lo, hi):
    got = by_id(subspace.drop_pc_band(df, "grp", lo, hi))
    for g in SIZES:
        ids = [r[0] for r in ROWS if r[1] == g]
        x = np.array([r[2] for r in ROWS if r[1] == g])
        x = x - x.mean(0)
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        band = vt[[j for j in range(lo, hi) if j < len(s) and s[j] > 1e-6]]
        assert np.allclose([got[i] for i in ids], x - x @ band.T @ band, atol=1e-9)


def test_whitened_rows_have_one_width(df):
    got = by_id(subspace.whiten(df, "grp", 3))
    assert len(got) == len(ROWS) and {len(v) for v in got.values()} == {3} and not np.any(got[0])


def test_other_operators_keep_every_group(df):
    assert subspace.spectrum(df, "grp").count() == 3
    assert subspace.drop_channels(df, "grp", "energy", 1, m=2).count() == len(ROWS)
    assert subspace.drop_group_subspace(df, "grp", "label").count() == len(ROWS)
    basis = subspace.pca_by(df.where("grp = 2"), "grp", 2)
    assert vectors.project_out(df, basis, "grp").count() == len(ROWS)
    assert {len(v) for v in by_id(vectors.coordinates(df, basis, "grp"), "z").values()} == {0, 2}
    for how in ("weighted", "trimmed"):
        assert subspace.drop_weighted_pcs(df.withColumn("s", F.col("clip_id").cast("double")), "grp", 1, "s", how).count() == len(ROWS)


def test_prior_of_a_single_group(df):
    one = df.where("grp = 2")
    got = knn.anchor_prior(one, one, 3).collect()
    assert len(got) == 12 and all(np.allclose(r["p"], 1 / 3) for r in got)


def test_class_means_are_those_of_centred_rows(df):
    soft = df.withColumn("p", F.array(*[F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in range(3)]))
    got = by_id(vectors.subtract_class_means(soft, "p", 3, "grp", 0.5))
    for g in SIZES:
        mine = [r for r in ROWS if r[1] == g]
        x = np.array([r[2] for r in mine])
        x = x - x.mean(0)
        lab = np.array([r[3] for r in mine])
        want = x - 0.5 * np.array([x[lab == c].mean(0) for c in lab])
        assert np.allclose([got[r[0]] for r in mine], want, atol=1e-6)


@pytest.mark.parametrize("n", [1, 5, 11, -5, -30])
def test_shifts_beyond_a_chunk(spark, n):
    rows = spark.range(20).withColumn("g", F.lit(1)).withColumn("v", F.col("id") * 10)
    got = {r["id"]: r["s"] for r in ordered.shifted(rows, "v", n, "g", "id", "s", chunk=3).collect()}
    assert got == {i: (10 * (i - n) if 0 <= i - n < 20 else None) for i in range(20)}


def test_quantiles_under_ties(spark):
    rng = np.random.default_rng(3)
    values = {0: [5.0] * 400, 1: rng.integers(0, 4, 333).astype(float).tolist(), 2: [1.5], 3: rng.normal(size=50).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [(1, None)], "g int, v double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["q"]): r["v"] for r in ordered.quantiles(df, "g", "v", qs).collect()}
    assert got.keys() == {(g, q) for g in values for q in qs}
    assert all(np.isclose(got[g, q], np.quantile(values[g], q)) for g, q in got)
    whole = {r["q"]: r["v"] for r in ordered.quantiles(df, None, "v", qs).collect()}
    assert all(np.isclose(whole[q], np.quantile(sum(values.values(), []), q)) for q in qs)


def test_ranks_keep_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, 1.0)], "i int, v double")
    assert {r["i"]: r["rank"] for r in ordered.average_ranks(df, "v").collect()} == {4: 1.0, 1: 2.5, 2: 2.5, 3: None}
