"""One softmax model per group, all groups at once.

The loss of a group is the mean log-loss of its rows plus ``ridge`` / 2 times the squared weights (the intercept is free). Its curvature never exceeds
half the second moments of the features, whatever the weights, so one inverse per group serves all steps: a step is one
aggregation of gradients for all groups together, and the loss falls in each. Momentum is restarted per group whenever the step turns against it.

Rows lie in blocks of about ``block_rows`` per (group, block): a group with a share of all rows spreads over many tasks, thousands of small groups
share them, and the weights of a group travel once per block and not once per row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.ordered import quantiles
from clipgraph.operators.vectors import gram_by
from clipgraph.session import cut, join_small, small_side

E = A.E
BLOCK_ROWS = 4096


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def blocks(rows: DataFrame, by: str, ident: str, x: str, y: str, use: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, ids, xs, ys, uses): about ``block_rows`` rows of a group per row."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    parts = join_small(rows, sizes, [by]).withColumn("_b", F.pmod(F.xxhash64(ident), F.ceil(F.col("_n") / block_rows)))
    packed = F.collect_list(F.struct(F.col(ident).alias("id"), E(f"concat({A.to_double(x)}, array(1D))").alias("x"), F.col(y).cast("int").alias("y"), F.col(use).alias("u")))
    got = parts.groupBy(by, "_b").agg(packed.alias("_p"))
    return cut(got.select(by, E("transform(_p, p -> p.id)").alias("ids"), E("transform(_p, p -> p.x)").alias("xs"), E("transform(_p, p -> p.y)").alias("ys"), E("transform(_p, p -> p.u)").alias("us")))


def fit(packed: DataFrame, rows: DataFrame, by: str, x: str, use: str, n_classes: int, ridge: float, tol: float = 1e-3, max_steps: int | None = None) -> DataFrame:
    """(group, w): class x (features + intercept) weights of every group with a used row.

    Steps go on until no group's scaled gradient exceeds ``tol``; a limit of steps that ends them earlier raises.
    """
    d = A.width_of(rows, x) + 1
    kind = dict(packed.dtypes)[by]
    used = rows.where(F.col(use)).withColumn("_x1", E(f"concat({A.to_double(x)}, array(1D))"))
    gram = gram_by(used, by, "_x1", center=False)

    def invert(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        n = f["n"].iloc[0]
        bound = np.stack(f["g"].to_numpy()) / (2 * n) + np.diag([ridge] * (d - 1) + [1e-9])
        return pd.DataFrame({by: [f[by].iloc[0]], "n": [n], "_inv": [list(np.linalg.inv(bound))]})

    inverse = cut(gram.groupBy(by).applyInPandas(invert, f"{by} {kind}, n double, _inv array<array<double>>"))
    zero = E(f"array_repeat(0D, {n_classes * d})")
    state = cut(inverse.select(by, "n", zero.alias("w"), zero.alias("v"), F.lit(0).alias("k"), F.lit(1.0).alias("size")))

    def gradients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for xs, ys, us, v in zip(f["xs"], f["ys"], f["us"], f["v"]):
                at = np.flatnonzero(us)
                m = np.stack(xs)[at] if len(at) else np.zeros((0, d))
                err = _softmax(m @ np.asarray(v).reshape(n_classes, d).T)
                err[np.arange(len(at)), np.asarray(ys, dtype=int)[at]] -= 1
                out.append((err.T @ m).ravel())
            yield pd.DataFrame({by: f[by], "g": out})

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            w2, v2, k2, size2 = [], [], [], []
            for g, n, w, v, k, inv in zip(f["g"], f["n"], f["w"], f["v"], f["k"], f["_inv"]):
                w, v = np.asarray(w).reshape(n_classes, d), np.asarray(v).reshape(n_classes, d)
                slope = np.asarray(g).reshape(n_classes, d) / n
                slope[:, :-1] += ridge * v[:, :-1]
                step = -slope @ np.stack(inv)
                new, k = v + step, k + 1
                if (slope * (new - w)).sum() > 0:
                    k = 1  # momentum points uphill
                w2.append(new.ravel())
                v2.append((new + (k - 1) / (k + 2) * (new - w)).ravel())
                k2.append(k)
                size2.append(float(np.sqrt(-(slope * step).sum())))
            yield pd.DataFrame({by: f[by], "n": f["n"], "w": w2, "v": v2, "k": k2, "size": size2})

    steps = 0
    while state.where(F.col("size") > tol).head(1):
        if max_steps is not None and steps >= max_steps:
            raise RuntimeError(f"fit: gradients still above {tol} after {max_steps} steps")
        side = small_side(state)
        parts = packed.join(side.select(by, "v"), by).select(by, "xs", "ys", "us", "v").mapInPandas(gradients, f"{by} {kind}, g array<double>")
        sums = parts.groupBy(by).agg(A.vec_sum("g").alias("g"))
        moved = sums.join(side, by).join(inverse.select(by, "_inv"), by).select(by, "g", "n", "w", "v", "k", "_inv")
        state = cut(moved.mapInPandas(move, f"{by} {kind}, n double, w array<double>, v array<double>, k int, size double"))
        steps += 1
    return state.select(by, "w")


def predict(packed: DataFrame, weights: DataFrame, by: str, ident: str, ident_type: str, n_classes: int, out: str = "s") -> DataFrame:
    """(group, id, class probabilities) of all rows of the groups that have a model."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, ids, xs, w in zip(f[by], f["ids"], f["xs"], f["w"]):
                m = np.stack(xs)
                yield pd.DataFrame({by: [g] * len(m), ident: ids, out: list(_softmax(m @ np.asarray(w).reshape(n_classes, -1).T))})

    joined = packed.join(small_side(weights), by).select(by, "ids", "xs", "w")
    return joined.mapInPandas(run, f"{by} {dict(packed.dtypes)[by]}, {ident} {ident_type}, {out} array<double>")


def self_train(df: DataFrame, probs: DataFrame, x: str, q: float, beta: float, n_classes: int, by: str = "grp", ridge: float = 0.01, ident: str = "clip_id",
               p: str = "p", min_rows: int | None = 200, min_classes: int | None = 5, tol: float = 1e-3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each group learns from its own most confident rows (at or above its ``q`` quantile) and is blended with its model: (1 - beta) p + beta s.

    Groups with fewer than ``min_rows`` confident rows or ``min_classes`` classes among them keep their probabilities; None takes every group.
    """
    rows = df.join(probs.select(ident, p), ident).withColumn("_conf", E(f"array_max({p})")).withColumn("_y", E(A.argmax(p)))
    level = quantiles(rows, by, "_conf", [q]).select(by, F.col("_conf").alias("_t"))
    rows = join_small(rows, level, [by]).withColumn("_sure", F.col("_conf") >= F.col("_t"))
    good = rows.where("_sure").groupBy(by).agg(F.count("*").alias("_n"), F.count_distinct("_y").alias("_c")) \
               .select(by, E(f"_n >= {min_rows or 0} AND _c >= {min_classes or 0}").alias("_ok"))
    rows = cut(join_small(rows, good, [by]).withColumn("_use", E("_sure AND _ok")))
    base = rows.select(by, ident, p)
    some = rows.where("_ok")
    if not some.head(1):
        return base
    packed = blocks(some, by, ident, x, "_y", "_use", block_rows)
    weights = fit(packed, some, by, x, "_use", n_classes, ridge, tol)
    scored = predict(packed, weights, by, ident, dict(df.dtypes)[ident], n_classes, "_s").drop(by)
    mixed = A.both(p, "_s", lambda a, b: f"{A.num(1 - beta)} * {a} + {A.num(beta)} * {b}")
    return base.join(scored, ident, "left").select(by, ident, E(f"IF(_s IS NULL, {p}, {mixed})").alias(p))
