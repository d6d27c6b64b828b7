"""Low-rank completion of sensor blocks on a graph, by conjugate gradients over tables.

Every clip was seen by one sensor s with loadings W_s and gets a latent row z; the latent rows minimise

    sum_i |x_i - W_s z_i|^2 + sig2 sum_i z_i' diag(1 / prior) z_i + lam sum_edges |z_i - z_j|^2

over directed edges. The normal equations are never built: a product with their matrix is one edge join with a partly combined sum
and a small matrix per sensor; the preconditioner is the inverse of the row's own r x r block, one per (sensor, degree). A step
needs two sums over the table and stops when the residual is ``tol`` of the right-hand side.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.session import cut, small_side

E = A.E


def _blocks(kinds: DataFrame, sensor: str, lam: float, ridge: np.ndarray) -> DataFrame:
    """Own matrix and its inverse for every (sensor, degree)."""
    def run(frames):
        for f in frames:
            own, inverse = [], []
            for w, deg in zip(f["w"], f["_deg"]):
                w = np.stack(w)
                g = w.T @ w + np.diag(ridge + 2 * lam * deg)
                own.append(list(g))
                inverse.append(list(np.linalg.inv(g)))
            yield pd.DataFrame({"_s": f[sensor], "_d": f["_deg"], "_own": own, "_inv": inverse})

    kind = dict(kinds.dtypes)[sensor]
    return kinds.mapInPandas(run, f"_s {kind}, _d double, _own array<array<double>>, _inv array<array<double>>")


def _times(m: str, v: str) -> str:
    return A.let(v, lambda x: A.each(m, lambda row: A.dot(row, x)))


def complete(df: DataFrame, loadings: DataFrame, edges: DataFrame, lam: float, sig2: float, prior: Sequence[float] | None = None,
             f: str = "f", sensor: str = "sensor", ident: str = "clip_id", tol: float = 1e-6, max_steps: int | None = None) -> DataFrame:
    """Add the latent row ``z``. ``loadings`` has a row per sensor with ``w`` (d vectors of length r); mutual edges count, in both directions.

    Rows whose sensor has no loadings have null ``z``. A limit of steps that ends the search before the residual is small raises.
    """
    r = A.width_of(loadings.select(E("w[0]").alias("_w0")), "_w0")
    ridge = sig2 / np.asarray([1.0] * r if prior is None else prior, dtype=float)
    one = edges.where("mutual").select("src", "dst").where("src <> dst")
    und = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    have = df.select(ident, sensor, f).join(loadings, sensor)
    ids = have.select(ident)
    und = cut(und.join(ids.withColumnRenamed(ident, "src"), "src", "left_semi").join(ids.withColumnRenamed(ident, "dst"), "dst", "left_semi"))
    deg = und.groupBy(F.col("src").alias(ident)).agg(F.count("*").cast("double").alias("_deg"))
    turned = F.expr(f"transform(sequence(0, {r - 1}), k -> transform(w, x -> x[k]))")
    rows = have.withColumn("_wt", turned).join(deg, ident, "left").withColumn("_deg", F.coalesce("_deg", F.lit(0.0)))
    rows = cut(rows.select(ident, sensor, "_deg", E(_times("_wt", A.to_double(f))).alias("_b")))
    kinds = rows.select(sensor, "_deg").distinct().join(loadings, sensor)
    blocks = small_side(_blocks(kinds, sensor, lam, ridge))  # one row per sensor and degree

    def with_blocks(t: DataFrame) -> DataFrame:
        return t.join(blocks, F.col(sensor).eqNullSafe(F.col("_s")) & (F.col("_deg") == F.col("_d"))).drop("_s", "_d")

    plain = [ident, sensor, "_deg"]
    start = with_blocks(rows).select(*plain, E(A.zeros("_b")).alias("z"), F.col("_b").alias("_res"), E(_times("_inv", "_b")).alias("_p"))
    state = cut(start)
    size, rs = state.agg(E(f"coalesce(sum({A.dot('_res', '_res')}), 0D)"), E(f"coalesce(sum({A.dot('_res', '_p')}), 0D)")).head()
    steps, left = 0, size
    while left > tol ** 2 * size:
        if max_steps is not None and steps >= max_steps:
            raise RuntimeError(f"complete: residual {np.sqrt(left / size):.2e} after {max_steps} steps")
        near = und.join(state.select(F.col(ident).alias("dst"), "_p"), "dst").groupBy(F.col("src").alias(ident)).agg(E(A.weighted_sums("_p", r, "1D")).alias("_nb"))
        own = _times("_own", "_p")
        product = A.both(own, "coalesce(_nb, " + A.zeros("_p") + ")", lambda x, y: f"{x} - {A.num(2 * lam)} * {y}")
        state = cut(with_blocks(state).join(near, ident, "left").select(*plain, "z", "_res", "_p", "_inv", E(product).alias("_q")))
        pq = state.agg(E(f"sum({A.dot('_p', '_q')})")).head()[0]
        alpha = A.num(float(rs / pq))
        state = state.select(*plain, E(A.both("z", "_p", lambda x, y: f"{x} + {alpha} * {y}")).alias("z"),
                             E(A.both("_res", "_q", lambda x, y: f"{x} - {alpha} * {y}")).alias("_res"), "_p", "_inv")
        state = state.withColumn("_y", E(_times("_inv", "_res")))
        left, new = state.agg(E(f"sum({A.dot('_res', '_res')})"), E(f"sum({A.dot('_res', '_y')})")).head()
        beta = A.num(float(new / rs))
        state = state.select(*plain, "z", "_res", E(A.both("_y", "_p", lambda x, y: f"{x} + {beta} * {y}")).alias("_p"))
        rs, steps = new, steps + 1
    return df.join(state.select(ident, "z"), ident, "left")
