"""Grouped folds, out-of-fold regressions and classifiers. Fits use distributed sums or Spark ML."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from clipgraph.functions import arrays as A
from clipgraph.operators.ordered import with_row_index
from clipgraph.operators.subspace import _per_matrix
from clipgraph.operators.vectors import gram_by
from clipgraph.session import cut, join_small, keys

E = A.E


# ---- folds -------------------------------------------------------------------------------------------------------

def group_kfold(df: DataFrame, by: str, n: int, seed: int = 0) -> DataFrame:
    """Group folds balanced by rows: groups, largest first, go to the lightest fold. (group, fold)

    Groups of one size are assigned together. With loads L and size s, fold f takes its j-th group of that size at
    load L_f + j s, so the sequential rule is the order of those values (ties to the lower fold), and the fold of the r-th group follows from r, s and L
    alone. Only (size, number of groups) pairs, at most about the square root of twice the row count, reach the driver.
    """
    spark = df.sparkSession
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_s"))
    ranked = with_row_index(sizes.withColumn("_h", F.xxhash64(F.lit(seed), F.col(by))), "_s", ["_h", by], out="_r")
    load = [0] * n
    plan = []
    for row in sizes.groupBy("_s").agg(F.count(F.lit(1)).alias("_m")).orderBy(F.desc("_s")).toLocalIterator():
        s, m = int(row["_s"]), int(row["_m"])
        plan.append((s, list(load)))
        load = [a + s * t for a, t in zip(load, _fill(load, s, m))]
    steps = spark.createDataFrame(plan, "_s long, _load array<long>")
    return join_small(ranked, steps, ["_s"]).select(by, _turn("_load", "_s", "_r").alias("fold"))


@F.pandas_udf(IntegerType())
def _turn(load: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
    """The fold of the ``rank``-th of equal groups: the placements before a level are counted, and the level is found by halving."""
    if not len(load):
        return pd.Series([], dtype="int32")
    loads, s, r = np.stack(load.to_numpy()).astype(np.int64), size.to_numpy(np.int64)[:, None], rank.to_numpy(np.int64)
    below = lambda v: np.maximum(0, -(-(v[:, None] - loads) // s)).sum(1)
    lo, hi = loads.min(1), loads.max(1) + s[:, 0] * (r + 1)
    while (lo < hi).any():  # largest level with at most ``rank`` placements below it
        mid = (lo + hi + 1) // 2
        fits = below(mid) <= r
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
    at = (lo[:, None] >= loads) & ((lo[:, None] - loads) % s == 0)  # folds with a placement at the level
    nth = np.cumsum(at, axis=1) - 1
    return pd.Series((at & (nth == (r - below(lo))[:, None])).argmax(1).astype(np.int32))


def _fill(load: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each fold takes when every one goes to the lightest fold."""
    lo, hi = min(load), max(load) + size * (count + 1)
    while lo < hi:  # smallest level below which at least ``count`` placements start
        mid = (lo + hi) // 2
        if sum(max(0, -(-(mid - x) // size)) for x in load) >= count:
            hi = mid
        else:
            lo = mid + 1
    taken = [max(0, -(-(lo - x) // size)) for x in load]
    extra = sum(taken) - count
    for f in reversed(range(len(load))):  # placements that start just below the level, last folds first
        if extra and taken[f] and load[f] + (taken[f] - 1) * size == lo - 1:
            taken[f] -= 1
            extra -= 1
    return taken


def hash_folds(df: DataFrame, by, n: int, seed: int = 0, draw: str | None = None) -> DataFrame:
    """Round-robin folds over the distinct keys in hash order: (key, fold)."""
    by = keys(by)
    distinct = df.select(*by).distinct()
    distinct = distinct.withColumn("_h", E(draw) if draw else F.xxhash64(F.lit(seed), *by))
    return with_row_index(distinct, None, ["_h", *by], out="_i").select(*by, (F.col("_i") % n).cast("int").alias("fold"))


def leave_one_group_out(df: DataFrame, by: str) -> DataFrame:
    """Every group its own fold: (group, fold)."""
    return with_row_index(df.select(by).distinct(), None, [by], out="fold").select(by, F.col("fold").cast("int"))


# ---- ridge -------------------------------------------------------------------------------------------------------

def ridge_fit(df: DataFrame, x: str, y: str, lams: Sequence[float], by=None, standardize: bool = True) -> DataFrame:
    """Ridge of a vector on a vector per training set: (group, lam, mu, coef, icept). One second-moment pass."""
    dx = A.width_of(df, x)
    gram = gram_by(df.select(*keys(by), F.concat(x, y).alias("_xy")), by, "_xy", center=False)
    return _ridge_solve(gram, keys(by), dx, lams, standardize)


def _ridge_solve(gram: DataFrame, by: list[str], dx: int, lams: Sequence[float], standardize: bool) -> DataFrame:
    lams = [float(v) for v in lams]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].iloc[0]
        mean = pdf["s"].to_numpy() / n
        g = np.stack(pdf["g"].to_numpy()) - n * np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(g)[:dx] / n, 0, None)) + 1e-6 if standardize else np.ones(dx)
        xx, xy = g[:dx, :dx] / np.outer(sd, sd), g[:dx, dx:] / sd[:, None]
        rows = []
        for lam in lams:
            w = np.linalg.solve(xx + lam * np.eye(dx), xy) / sd[:, None]
            rows.append((lam, list(w.T), mean[dx:] - mean[:dx] @ w))
        return pd.DataFrame(rows, columns=["lam", "coef", "icept"])

    return _per_matrix(gram, by, solve, "lam double, coef array<array<double>>, icept array<double>")


def linear_apply(x: str) -> str:
    """SQL text: coef . x + icept for coef rows."""
    return A.both("coef", "icept", lambda w, b: f"{A.dot(w, x)} + {b}")


def ridge_oof(df: DataFrame, x: str, y: str, lam: float | Sequence[float], folds: DataFrame, by: str,
              out: str = "yhat", standardize: bool = True) -> DataFrame:
    """Out-of-fold ridge predictions. A fold's training sums are the totals minus its own, so rows are summed once."""
    lams = [lam] if isinstance(lam, (int, float)) else list(lam)
    rows = join_small(df, folds, [by])
    dx = A.width_of(df, x)
    own = cut(gram_by(rows.select("fold", F.concat(x, y).alias("_xy")), "fold", "_xy", center=False))
    total = own.groupBy("i").agg(A.vec_sum("g").alias("_g"), F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    train = own.join(total, "i").select("fold", "i", E(A.sub("_g", "g")).alias("g"), (F.col("_s") - F.col("s")).alias("s"),
                                        (F.col("_n") - F.col("n")).alias("n"))
    models = cut(_ridge_solve(train, ["fold"], dx, lams, standardize))
    return join_small(rows, models, ["fold"]).withColumn(out, E(linear_apply(x))).drop("coef", "icept")


def ridge_cv(df: DataFrame, x: str, y: str, lams: Sequence[float], folds: DataFrame, by: str) -> DataFrame:
    """Out-of-fold predictions of the penalty with the smallest out-of-fold error: all penalties share one pass."""
    preds = cut(ridge_oof(df, x, y, lams, folds, by))
    err = preds.groupBy("lam").agg(F.sum(E(A.let(A.sub(y, "yhat"), lambda d: A.dot(d, d)))).alias("_e"))
    best = err.agg(F.min_by("lam", F.struct("_e", "lam")).alias("lam"))  # one row
    return preds.join(F.broadcast(best), "lam")


def residualize(df: DataFrame, y: str, x: str, alpha: float, by=None) -> DataFrame:
    """y minus its ridge fit on x (the group mean of y stays)."""
    by = keys(by)
    model = ridge_fit(df, x, y, [alpha], by, standardize=False).drop("lam")
    mean = df.groupBy(*by).agg(A.vec_mean(y).alias("_ym"))
    joined = join_small(df, model.join(mean, by), by) if by else df.crossJoin(F.broadcast(model)).crossJoin(F.broadcast(mean))
    return joined.withColumn(y, E(A.add(A.sub(y, linear_apply(x)), "_ym"))).drop("coef", "icept", "_ym")


def transfer_readout(src: DataFrame, dst: DataFrame, x: str, y: str, lam: float = 1.0) -> DataFrame:
    """A linear read-out learned on one table, applied to another: dst with yhat."""
    model = ridge_fit(src, x, y, [lam]).drop("lam")
    return dst.crossJoin(F.broadcast(model)).withColumn("yhat", E(linear_apply(x))).drop("coef", "icept")  # one row


# ---- classifiers -------------------------------------------------------------------------------------------------

def default_classifier(seed: int = 0) -> Estimator:
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=20, maxDepth=6, seed=seed)


def classifier_oof(df: DataFrame, x: str, y: str, folds: DataFrame, by: str, n_classes: int,
                   estimator: Estimator | None = None, test: DataFrame | None = None, weight: str | None = None,
                   train_filter: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold class probabilities; a test table gets the mean over the fold models. One fit per fold."""
    est = estimator or default_classifier()
    if weight:
        est = est.copy({est.getParam("weightCol"): weight})
    vec = lambda d: d.withColumn("features", array_to_vector(E(A.to_double(x))))
    rows = vec(join_small(df, folds, [by])).withColumn("label", F.col(y).cast("double"))
    rows = cut(rows)  # every fold reads it several times
    names = sorted(r["fold"] for r in folds.select("fold").distinct().collect())  # the fold numbers
    pad = A.let("_p", lambda p: f"transform(sequence(0, {n_classes - 1}), i -> IF(i < size({p}), {p}[i], 0D))")
    parts, tests = [], []
    for f in names:
        train = rows.where(F.col("fold") != f)
        train = train.where(train_filter) if train_filter else train
        model = est.fit(train)
        scored = model.transform(rows.where(F.col("fold") == f)).withColumn("_p", vector_to_array("probability"))
        parts.append(scored.withColumn("p", E(pad)).select(*df.columns, "fold", "p"))
        if test is not None:
            scored = model.transform(vec(test)).withColumn("_p", vector_to_array("probability"))
            tests.append(scored.withColumn("p", E(pad)).select(*test.columns, "p"))
    oof = reduce(DataFrame.unionByName, parts)
    if test is None:
        return oof, None
    every = reduce(DataFrame.unionByName, tests)
    key = [c for c in test.columns if c != x]
    return oof, every.groupBy(*key).agg(E(A.mean_array("p", n_classes)).alias("p"))


def family_oof(df: DataFrame, x: str, y: str, families: dict[str, Sequence[int]], folds: DataFrame, by: str,
               estimator: Estimator | None = None) -> DataFrame:
    """Per family of classes: probabilities within the family for all rows, models trained on family rows only."""
    out = []
    for name, ids in families.items():
        pos = "CASE " + y + " " + " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(ids)) + " ELSE -1 END"
        rows = df.withColumn("_within", E(pos))
        oof, _ = classifier_oof(rows, x, "_within", folds, by, len(ids), estimator, train_filter="_within >= 0")
        out.append(oof.drop("_within").withColumn("family", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def stage2_features(df: DataFrame, edges: DataFrame, probs: DataFrame, n_sensors: int, f: str = "f", sensor: str = "sensor",
                    ident: str = "clip_id", p: str = "p") -> DataFrame:
    """[own features, neighbour means per sensor, neighbour counts, sensor one-hot, probabilities] as ``x``."""
    from clipgraph.operators.knn import pool_neighbors

    d = A.width_of(df, f)
    pooled = pool_neighbors(edges, df, sensor, f, ident)
    cells = [F.max(F.when(F.col(sensor) == s, F.col(f))).alias(f"_f{s}") for s in range(n_sensors)]
    counts = [F.max(F.when(F.col(sensor) == s, F.col("n"))).alias(f"_n{s}") for s in range(n_sensors)]
    wide = pooled.groupBy(F.col("src").alias(ident)).agg(*cells, *counts)
    blocks_ = ", ".join(f"coalesce(_f{s}, array_repeat(0D, {d}))" for s in range(n_sensors))
    numbers = "array(" + ", ".join(f"CAST(coalesce(_n{s}, 0) AS DOUBLE)" for s in range(n_sensors)) + ")"
    joined = df.join(wide, ident).join(probs.select(ident, F.col(p).alias("_q")), ident)
    return joined.withColumn("x", E(f"concat({f}, {blocks_}, {numbers}, {A.one_hot(sensor, n_sensors)}, _q)")) \
                 .drop("_q", *[f"_{c}{s}" for c in "fn" for s in range(n_sensors)])


def impute_blocks(df: DataFrame, edges: DataFrame, n_sensors: int, f: str = "f", sensor: str = "sensor",
                  ident: str = "clip_id") -> DataFrame:
    """One block per sensor: the row's own features in its own block, neighbour means (self included) elsewhere."""
    from clipgraph.operators.knn import pool_neighbors

    d = A.width_of(df, f)
    pooled = pool_neighbors(edges, df, sensor, f, ident).select(F.col("src").alias(ident), F.col(sensor).alias("block"),
                                                                F.col(f).alias("_pool"))
    want = df.withColumn("block", E(f"explode(sequence(0, {n_sensors - 1}))"))
    return want.join(pooled, [ident, "block"], "left").withColumn(
        f, E(f"IF(block = {sensor}, {f}, coalesce(_pool, array_repeat(0D, {d})))")).drop("_pool")


LINK_FEATURES = ["d_last", "d_ext", "d_mean", "same", "d_signal", "rank_row", "rank_col", "signal_row", "signal_col"]


def link_scorer(pairs: DataFrame, label: str, fold: str, features: Sequence[str] = tuple(LINK_FEATURES)) -> DataFrame:
    """Two-group cross-fit logistic link probability of candidate pairs: trained on one half, applied to the other."""
    rows = pairs.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features])) \
                .withColumn("_raw", array_to_vector("_x")).withColumn("_label", F.col(label).cast("double"))
    rows = cut(rows)
    parts = []
    for f in (0, 1):
        train, test = rows.where(F.col(fold) != f), rows.where(F.col(fold) == f)
        scaler = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True).fit(train)
        model = LogisticRegression(featuresCol="_std", labelCol="_label", probabilityCol="_prob", maxIter=50) \
            .fit(scaler.transform(train))
        parts.append(model.transform(scaler.transform(test)).withColumn("link_p", vector_to_array("_prob")[1])
                     .select(*pairs.columns, "link_p"))
    return parts[0].unionByName(parts[1])


def fit_soft_labels(df: DataFrame, x: str, p: str, max_iter: int = 50):
    """A classifier on soft labels: a row appears once per class with a probability above 0, weighted by it."""
    long = df.select(array_to_vector(E(A.to_double(x))).alias("features"), E(f"posexplode({p})").alias("_c", "weight")) \
             .where("weight > 0").withColumn("label", F.col("_c").cast("double"))
    return LogisticRegression(maxIter=max_iter, weightCol="weight").fit(long)


def pca_input(df: DataFrame, x: str, k: int, every: int = 1, by=None, order: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Coordinates in k principal components fitted on all rows (or on every ``every``-th one), as ``z``."""
    rows = df.withColumn("_v", array_to_vector(E(A.to_double(x))))
    fit_rows = rows if every == 1 else with_row_index(rows, by, list(order), out="_i").where(F.col("_i") % every == 0)
    model = PCA(k=k, inputCol="_v", outputCol="_z").fit(fit_rows)
    return model.transform(rows).withColumn("z", vector_to_array("_z")).drop("_v", "_z")
