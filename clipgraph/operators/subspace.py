"""Subspace operators: every estimate starts from a distributed second-moment table; only d x d matrices are solved."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.ordered import quantiles
from clipgraph.operators.vectors import center_by, coordinates, gram_by, project_out
from clipgraph.session import cut, join_small, keys

E = A.E


def _per_matrix(gram: DataFrame, by: list[str], solve, schema: str, columns: tuple[str, ...] = ("i", "g")) -> DataFrame:
    """Run ``solve(pdf sorted by i)`` once per group on the d rows of its matrix."""
    types = dict(gram.dtypes)
    full = ", ".join([f"{b} {types[b]}" for b in by] + [schema])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve(pdf.sort_values("i"))
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0])
        return out

    key = by or [F.lit(1).alias("_all")]
    return gram.groupBy(*key).applyInPandas(run, full)


def _vectors(rows: np.ndarray) -> pd.Series:
    """A column of vectors that stays one when there are none (a group of rank 0)."""
    return pd.Series(list(rows), dtype=object)


def pca_by(df: DataFrame, by, m: int | None = None, f: str = "f", weight: str | None = None) -> DataFrame:
    """Principal directions per group, strongest first: (group, j, b, lam, share). The sign makes the largest entry
    positive."""
    by = keys(by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lam, vec = np.linalg.eigh(np.stack(pdf["g"].to_numpy()))
        lam, vec = np.clip(lam[::-1], 0, None), vec[:, ::-1]
        rank = int((lam > lam[0] * 1e-12).sum()) if lam[0] > 0 else 0
        k = rank if m is None else min(m, rank)
        vec = vec[:, :k].T
        top = np.abs(vec).argmax(1) if k else np.array([], int)
        vec = vec * np.sign(vec[np.arange(k), top])[:, None]
        return pd.DataFrame({"j": np.arange(k, dtype=np.int32), "b": _vectors(vec), "lam": lam[:k],
                             "share": lam[:k] / max(lam.sum(), 1e-300)})

    return cut(_per_matrix(gram_by(df, by, f, weight), by, solve, "j int, b array<double>, lam double, share double"))


def drop_top_pcs(df: DataFrame, by, m: int, f: str = "f") -> DataFrame:
    """Centre, then remove the top m principal directions of each group; m <= 0 leaves the rows alone."""
    return df if m <= 0 else drop_pc_band(df, by, 0, m, f)


def drop_pc_band(df: DataFrame, by, lo: int, hi: int, f: str = "f") -> DataFrame:
    """Centre, then remove the directions lo..hi-1."""
    basis = pca_by(df, by, hi, f).where(F.col("j") >= lo)
    return project_out(center_by(df, by, f), basis, by, f)


def drop_weighted_pcs(df: DataFrame, by, m: int, spread: str, how: str, q: float = 0.5, f: str = "f", slack: int | None = 5) -> DataFrame:
    """Remove directions estimated robustly: weights 1 / (1 + spread / median), or only rows with spread <= quantile.

    Both thresholds are exact quantiles found by position. A trimmed group of at most m + ``slack`` rows uses all rows
    (``slack=None``: never).
    """
    by = keys(by)
    level = 0.5 if how == "weighted" else q
    cut_at = quantiles(df, by, spread, [level]).select(*by, F.col(spread).alias("_t"))
    rows = df.join(cut_at, by)
    if how == "weighted":
        rows = rows.withColumn("_w", E(f"1 / (1 + {spread} / (_t + 1e-9D))"))
    else:
        kept = rows.groupBy(*by).agg(F.count_if(E(f"{spread} <= _t")).alias("_kept"))
        rows = rows.join(kept, by).withColumn("_w", E(f"IF(_kept <= {-1 if slack is None else m + slack} OR {spread} <= _t, 1D, 0D)"))
    return project_out(center_by(df, by, f), pca_by(rows, by, m, f, "_w"), by, f)


def whiten(df: DataFrame, by, n: int, f: str = "f", equalize: bool = True) -> DataFrame:
    """Coordinates in the top n directions, scaled to unit variance when ``equalize``; zeros where a group has fewer directions."""
    by = keys(by)
    basis = pca_by(df, by, n, f)
    if equalize:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        basis = (basis.join(sizes, by) if by else basis.crossJoin(F.broadcast(sizes))) \
            .withColumn("b", E(A.scale("b", "sqrt(_n / greatest(lam, 1e-300D))")))
    return coordinates(center_by(df, by, f), basis, by, f, out=f, width=n)


def truncate(df: DataFrame, by, n: int, f: str = "f") -> DataFrame:
    return whiten(df, by, n, f, equalize=False)


def drop_group_subspace(df: DataFrame, by, nuisance: str, f: str = "f", min_rows: int = 2) -> DataFrame:
    """Centre the group, then remove the span of the (centred) centroids of a nuisance value."""
    by = keys(by)
    centered = center_by(df, by, f)
    cents = centered.groupBy(*by, nuisance).agg(A.vec_mean(f).alias("_c"), F.count(F.lit(1)).alias("_n")) \
                    .where(F.col("_n") > min_rows)
    basis = span_basis(cents.select(*by, nuisance, "_c"), by, "_c", center=True)
    return project_out(centered, basis, by, f)


def span_basis(rows: DataFrame, by, vec: str, center: bool = False, rank: int | None = None) -> DataFrame:
    """Orthonormal basis of a handful of vectors per group (class or sensor means): (group, j, b)."""
    by = keys(by)
    types = dict(rows.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["j int", "b array<double>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vec].to_numpy())
        x = x - x.mean(0) if center else x
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        k = int((s > 1e-9 * max(s.max(), 1e-300)).sum()) if len(s) else 0
        k = k if rank is None else min(k, rank)
        out = pd.DataFrame({"j": np.arange(k, dtype=np.int32), "b": _vectors(vt[:k])})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0])
        return out

    return rows.groupBy(*(by or [F.lit(1).alias("_all")])).applyInPandas(run, schema)


def drop_channels(df: DataFrame, by, rank: str, j: int, f: str = "f", m: int = 30) -> DataFrame:
    """Remove the j channels of largest variance, or of largest energy in the top m principal directions."""
    by = keys(by)
    if rank == "variance":
        score = gram_by(df, by, f).select(*by, "i", E("g[i]").alias("_e"))
    else:
        score = pca_by(df, by, m, f).select(*by, "lam", E("posexplode(b)").alias("i", "_v")) \
            .groupBy(*by, "i").agg(F.sum(E("lam * _v * _v")).alias("_e"))
    w = Window.partitionBy(*by).orderBy(F.desc("_e"), "i")  # d rows per group
    top = score.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= j)
    dropped = top.groupBy(*by).agg(F.collect_set("i").alias("_drop"))
    joined = join_small(df, dropped, by, "left")
    return joined.withColumn(f, E(f"filter({f}, (x, i) -> NOT array_contains(coalesce(_drop, array()), i))")).drop("_drop")


def spectrum(df: DataFrame, by, f: str = "f") -> DataFrame:
    """Variance share of the first, top 10 and top 30 directions, effective dimension, mean cosine of distinct pairs.

    The mean over all pairs follows from the norm of the summed unit rows; no pair is drawn.
    """
    by = keys(by)
    eig = pca_by(df, by, None, f).groupBy(*by).agg(
        F.sum(E("IF(j < 1, share, 0D)")).alias("pc1"), F.sum(E("IF(j < 10, share, 0D)")).alias("top10"),
        F.sum(E("IF(j < 30, share, 0D)")).alias("top30"), (1 / F.sum(E("share * share"))).alias("eff_dim"))
    cos = mean_pair_cosine(df, by, f)
    return join_small(cos, eig, by, "left")  # a group of rank 0 has no directions and keeps its row


def mean_pair_cosine(df: DataFrame, by, f: str = "f") -> DataFrame:
    by = keys(by)
    unit = center_by(df, by, f).withColumn(f, E(A.l2_normalize(f)))
    g = unit.groupBy(*by).agg(A.vec_sum(f).alias("_s"), F.sum(E(A.dot(f, f))).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return g.select(*by, E(f"({A.dot('_s', '_s')} - _d) / nullif(_n * (_n - 1), 0)").alias("mean_cos"))


def class_mean_basis(df: DataFrame, by: str, label: str, drop_null: bool = True, f: str = "f",
                     rank: int | None = None) -> DataFrame:
    """Per group, the span of the class means of all *other* groups (totals minus own): (group, j, b)."""
    rows = df.where(F.col(label) != 0) if drop_null else df
    own = rows.groupBy(by, label).agg(A.vec_sum(f).alias("_s"), F.count(F.lit(1)).alias("_n"))
    total = own.groupBy(label).agg(A.vec_sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    # the class totals (one vector per class) travel as a single row
    packed = total.agg(F.collect_list(F.struct(label, "_ts", "_tn")).alias("_all"))
    grid = df.select(by).distinct().crossJoin(F.broadcast(packed)).select(by, E("inline(_all)")) \
             .join(own, [by, label], "left")
    mean = A.divide(f"IF(_s IS NULL, _ts, {A.sub('_ts', '_s')})", "(_tn - coalesce(_n, 0))")
    means = grid.where("_tn - coalesce(_n, 0) > 0").select(by, label, E(mean).alias("_c"))
    return span_basis(means, by, "_c", center=True, rank=rank)


def lda_basis(df: DataFrame, by, label: str, k: int, shrink: float = 0.1, f: str = "f") -> DataFrame:
    """Top k discriminant directions from class scatter with a shrunk within-class covariance, orthonormalised."""
    by = keys(by)
    means = df.groupBy(*by, label).agg(A.vec_mean(f).alias("_c"), F.count(F.lit(1)).alias("_n"))
    within = gram_by(center_by(df, [*by, label], f), by, f, center=False).withColumn("part", F.lit("w"))
    between = gram_by(means.withColumnRenamed("_c", f).withColumn("_w", F.col("_n").cast("double")), by, f, "_w") \
        .withColumn("part", F.lit("b"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.stack(pdf[pdf["part"] == "w"].sort_values("i")["g"].to_numpy()) / pdf["n"].iloc[0]
        b = np.stack(pdf[pdf["part"] == "b"].sort_values("i")["g"].to_numpy()) / pdf["n"].iloc[0]
        d = len(w)
        w = (1 - shrink) * w + shrink * np.trace(w) / d * np.eye(d)
        root = np.linalg.inv(np.linalg.cholesky(w))
        lam, vec = np.linalg.eigh(root @ b @ root.T)
        q, _ = np.linalg.qr(root.T @ vec[:, ::-1][:, :k])
        return pd.DataFrame({"j": np.arange(q.shape[1], dtype=np.int32), "b": list(q.T)})

    return _per_matrix(within.unionByName(between), by, solve, "j int, b array<double>")


def cca(df: DataFrame, x: str, y: str, k: int, ridge: float = 1e-3, by=None) -> DataFrame:
    """Shared directions of two blocks after ridge whitening: (group, j, a, b, rho). One joint second-moment pass."""
    by = keys(by)
    dx = A.width_of(df, x)
    gram = gram_by(df.withColumn("_xy", F.concat(x, y)), by, "_xy")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(pdf["g"].to_numpy()) / pdf["n"].iloc[0]
        cxx, cyy, cxy = g[:dx, :dx], g[dx:, dx:], g[:dx, dx:]
        wx = _inverse_root(cxx + ridge * np.trace(cxx) / dx * np.eye(dx))
        wy = _inverse_root(cyy + ridge * np.trace(cyy) / len(cyy) * np.eye(len(cyy)))
        u, s, vt = np.linalg.svd(wx @ cxy @ wy)
        n = min(k, len(s))
        return pd.DataFrame({"j": np.arange(n, dtype=np.int32), "a": list((wx @ u[:, :n]).T),
                             "b": list((wy @ vt[:n].T).T), "rho": s[:n]})

    return _per_matrix(gram, by, solve, "j int, a array<double>, b array<double>, rho double")


def _inverse_root(c: np.ndarray) -> np.ndarray:
    lam, vec = np.linalg.eigh(c)
    return vec @ np.diag(1 / np.sqrt(np.clip(lam, 1e-12, None))) @ vec.T
