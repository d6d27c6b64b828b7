"""Probability tables: ensembles, sharpening, prior correction, decisions and their tuning."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.metrics import confusion, macro_f1, prf
from clipgraph.session import cut, join_small, keys


def normalize_probs(df: DataFrame, p: str = "p", fallback: str = "zero") -> DataFrame:
    return df.withColumn(p, A.E(A.normalize(p, fallback)))


def drop_empty(df: DataFrame, p: str = "p", floor: float = 1e-6) -> DataFrame:
    """Drop rows without probability mass and renormalise the rest."""
    return df.where(A.E(f"{A.vsum(p)} > {A.num(floor)}")).withColumn(p, A.E(A.divide_by_sum(p)))


def ensemble(probs: DataFrame, weights: dict[str, float], how: str = "arith", model: str = "model",
             by: Sequence[str] = ("clip_id",), p: str = "p") -> DataFrame:
    """Combine the rows of several models per clip; every row is normalised first.

    arith: weighted mean, rows without any mass dropped. geo: weighted mean of logs, renormalised.
    """
    n = A.width_of(probs, p)
    cases = " ".join(f"WHEN '{m}' THEN {A.num(w)}" for m, w in weights.items())
    total = A.num(sum(weights.values()))
    rows = probs.where(F.col(model).isin(list(weights))).withColumn("_w", A.E(f"CASE {model} {cases} END"))
    if how == "arith":
        rows = rows.withColumn("_p", A.E(A.normalize(p)))
        out = rows.groupBy(*by).agg(A.E(A.weighted_sums("_p", n, f"_w / {total}")).alias(p))
        return drop_empty(out, p)
    rows = rows.withColumn("_p", A.E(A.log_each(A.normalize(p))))
    out = rows.groupBy(*by).agg(A.E(A.weighted_sums("_p", n, f"_w / {total}")).alias(p))
    return out.withColumn(p, A.E(A.softmax(p)))


def sharpen(df: DataFrame, temp: float, p: str = "p") -> DataFrame:
    return df.withColumn(p, A.E(A.sharpen(p, temp)))


def pool(q: DataFrame, v: DataFrame, g: float, gated: bool = False, ident: str = "clip_id",
         p: str = "p") -> DataFrame:
    """Log-linear pooling of two tables, uniform or gated by the first one's lack of confidence."""
    if g == 0:
        return q
    gate = f"{A.num(g)} * (1 - array_max({p}))" if gated else g
    return q.join(v.select(ident, F.col(p).alias("_v")), ident).withColumn(p, A.E(A.pool(p, "_v", gate))).drop("_v")


def blend(q: DataFrame, s: DataFrame, w: float, how: str = "log", ident: str = "clip_id", p: str = "p") -> DataFrame:
    """Mix two tables: exp((1-w) ln(q + 1e-9) + w ln(s + 1e-9)) renormalised, or linear."""
    joined = q.join(s.select(ident, F.col(p).alias("_s")), ident)
    if how == "linear":
        mixed = A.both(p, "_s", lambda x, y: f"(1 - {A.num(w)}) * {x} + {A.num(w)} * {y}")
    else:
        mixed = A.softmax(A.both(p, "_s", lambda x, y: f"(1 - {A.num(w)}) * ln({x} + 1e-9D) + {A.num(w)} * ln({y} + 1e-9D)"))
    return joined.withColumn(p, A.E(mixed)).drop("_s")


def with_prior(df: DataFrame, by=None, p: str = "p", out: str = "prior") -> DataFrame:
    """Attach the mean probability row, over everything or per group."""
    n = A.width_of(df, p)
    if not keys(by):
        return df.crossJoin(F.broadcast(df.agg(A.E(A.mean_array(p, n)).alias(out))))  # one row
    return join_small(df, df.groupBy(*keys(by)).agg(A.E(A.mean_array(p, n)).alias(out)), keys(by))


def prior_correct(df: DataFrame, tau: float, by=None, p: str = "p") -> DataFrame:
    """p / (prior + 1e-9)^tau, not renormalised."""
    return with_prior(df, by, p, "_prior").withColumn(p, A.E(corrected(p, "_prior", A.num(tau)))).drop("_prior")


def corrected(p: str, prior: str, tau: str) -> str:
    return A.both(p, prior, lambda x, m: f"{x} / pow({m} + 1e-9D, {tau})")


TAU_GRID = [i * 0.05 for i in range(41)]


def with_grid(df: DataFrame, grid: Sequence[dict], name: str = "cfg") -> DataFrame:
    """One copy of every row per configuration, as columns. The grid is a literal, so no join is needed."""
    fields = list(grid[0])
    literal = lambda v: f"'{v}'" if isinstance(v, str) else A.num(v) if isinstance(v, float) else str(v)
    rows = ", ".join("named_struct(" + ", ".join(f"'{k}', {literal(c[k])}" for k in fields) + ")" for c in grid)
    return df.withColumn(name, A.E(f"explode(array({rows}))")).select("*", f"{name}.*").drop(name)


def tau_scores(df: DataFrame, n_classes: int, taus: Sequence[float] = TAU_GRID, by=None, p: str = "p",
               y: str = "label") -> DataFrame:
    """Macro-F1 after prior correction for every tau, in one job: (tau, f1)."""
    rows = with_grid(with_prior(df, by, p, "_prior").select(p, y, "_prior"), [{"tau": float(t)} for t in taus])
    pred = rows.select("tau", y, A.E(A.argmax(corrected(p, "_prior", "tau"))).alias("pred"))
    return macro_f1(prf(confusion(pred, y, "pred", ["tau"]), "tau", y, "pred"), n_classes, "tau")


def tune_tau(df: DataFrame, n_classes: int, taus: Sequence[float] = TAU_GRID, by=None, p: str = "p",
             y: str = "label") -> DataFrame:
    """The best tau, the smallest among equals: one row (tau, f1)."""
    scores = tau_scores(df, n_classes, taus, by, p, y)
    return scores.agg(F.max_by("tau", F.struct("f1", -F.col("tau"))).alias("tau"), F.max("f1").alias("f1"))


def tune_weights(df: DataFrame, n_classes: int, sweeps: int = 3, grid: Sequence[float] | None = None, p: str = "p",
                 y: str = "label") -> tuple[float, list[float]]:
    """Coordinate ascent on per-class log weights.

    The offsets of one class are scored together in one job; after an improvement the rest of the grid is scored again
    from the new weight, so the path equals a sequential search. Only per-offset scores reach the driver.
    """
    grid = [i * 0.1 - 1.0 for i in range(21)] if grid is None else list(grid)
    rows = cut(df.select(A.E(A.each(p, lambda x: f"ln({x} + 1e-9D)")).alias("_l"), y))
    logw = [0.0] * n_classes

    def score(c: int, offsets: list[float]) -> list[float]:
        base = "array(" + ", ".join(A.num(w) for w in logw) + ")"
        cand = with_grid(rows, [{"pos": i, "off": float(o)} for i, o in enumerate(offsets)])
        moved = f"transform({base}, (w, i) -> IF(i = {c}, w + off, w))"
        pred = cand.select("pos", y, A.E(A.argmax(A.add("_l", moved))).alias("pred"))
        table = macro_f1(prf(confusion(pred, y, "pred", ["pos"]), "pos", y, "pred"), n_classes, "pos")
        found = {r["pos"]: r["f1"] for r in table.collect()}  # one score per offset
        return [found.get(i, 0.0) for i in range(len(offsets))]

    best = score(0, [0.0])[0]
    for _ in range(sweeps):
        for c in range(n_classes):
            rest = list(grid)
            while rest:
                scores = score(c, rest)
                hit = next((i for i, s in enumerate(scores) if s > best), None)
                if hit is None:
                    break
                best = scores[hit]
                logw[c] += rest[hit]
                rest = rest[hit + 1:]
    return best, logw


def decide(df: DataFrame, p: str = "p", out: str = "pred") -> DataFrame:
    return df.withColumn(out, A.E(A.argmax(p)))


def null_gate(df: DataFrame, score: str, threshold: float | str, p: str = "p", out: str = "pred") -> DataFrame:
    """Class 0 where the score reaches the threshold, else the best other class."""
    th = threshold if isinstance(threshold, str) else A.num(threshold)
    rest = f"CAST({A.argmax(f'slice({p}, 2, size({p}) - 1)')} + 1 AS INT)"
    return df.withColumn(out, A.E(f"IF({score} >= {th}, 0, {rest})"))


def resplit_family(df: DataFrame, family: Sequence[int], within: str, w: float, p: str = "p") -> DataFrame:
    """Redistribute the mass of a class family by a log mix with ``within``, keeping its total."""
    take = "array(" + ", ".join(f"{p}[{c}]" for c in family) + ")"
    pos = "map(" + ", ".join(f"{c}, {i}" for i, c in enumerate(family)) + ")"
    share = A.let(take, lambda t: A.each(t, lambda x: f"{x} / greatest({A.vsum(t)}, 1e-12D)"))
    mixed = A.softmax(A.both(share, within, lambda x, y: f"{A.num(1 - w)} * ln({x} + 1e-9D) + {A.num(w)} * ln({y} + 1e-9D)"))
    out = df.withColumn("_mix", A.E(mixed)).withColumn("_mass", A.E(A.vsum(take)))
    put = f"transform({p}, (x, i) -> IF(element_at({pos}, i) IS NULL, x, _mass * _mix[element_at({pos}, i)]))"
    return out.withColumn(p, A.E(put)).drop("_mix", "_mass")


def average_sensors(probs: DataFrame, k: int, seed: int = 0, ident: str = "clip_id", sensor: str = "sensor",
                    p: str = "p") -> DataFrame:
    """Mean of the rows of k sensors per clip, drawn by a hash of the key. A clip has as many rows as sensors."""
    n = A.width_of(probs, p)
    w = Window.partitionBy(ident).orderBy(F.xxhash64(F.lit(seed), F.col(ident), F.col(sensor)), sensor)
    picked = probs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    out = picked.groupBy(ident).agg(A.E(A.mean_array(p, n)).alias(p))
    return out.withColumn(p, A.E(A.normalize(p)))


def smooth_links(q: DataFrame, links: DataFrame, a: float, iters: int = 10, ident: str = "clip_id",
                 p: str = "p", every: int = 5) -> DataFrame:
    """Q <- (1 - a) Q0 + a mean(linked Q), renormalised, along an undirected link table."""
    from clipgraph.operators.graph import neighbor_sum, row_side

    n = A.width_of(q, p)
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.distinct()
    deg = both.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    both = cut(both.join(deg, "src").select("src", "dst", (1 / F.col("_d")).alias("w")))
    base = cut(q)
    side = row_side(base, ident, p)
    z = base.select(ident, p)
    step_p = A.divide_by_sum(f"IF(agg IS NULL, {p}, " + A.both(
        p, "agg", lambda x, y: f"{A.num(1 - a)} * {x} + {A.num(a)} * {y}") + ")")
    for step in range(1, iters + 1):
        agg = neighbor_sum(both, z, n, ident, p, side=side).withColumnRenamed("src", ident)
        z = base.join(agg, ident, "left").select(ident, A.E(step_p).alias(p))
        if step % every == 0 and step < iters:
            z = cut(z)
    return base.drop(p).join(z, ident)


def describe(df: DataFrame, by=None, p: str = "p") -> DataFrame:
    """Maximum probability (mean, median) and entropy per group. The median is exact and found by position."""
    from clipgraph.operators.ordered import quantiles

    by = keys(by)
    rows = df.select(*by, A.E(f"array_max({p})").alias("top"), A.E(A.entropy(p)).alias("entropy"))
    means = rows.groupBy(*by).agg(F.avg("top").alias("mean_top"), F.avg("entropy").alias("mean_entropy"))
    med = quantiles(rows, by, "top", [0.5]).select(*by, F.col("top").alias("median_top"))
    return means.join(med, by) if by else means.crossJoin(med)


def drift(a: DataFrame, b: DataFrame, pred: str = "pred") -> DataFrame:
    """Class share in two tables and the difference, all classes of either."""
    def share(df, name):
        counts = df.groupBy(pred).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n").alias("_t"))  # one row
        return counts.crossJoin(F.broadcast(total)).select(pred, (F.col("_n") / F.col("_t")).alias(name))
    joined = share(a, "share_a").join(share(b, "share_b"), pred, "full_outer").na.fill(0.0, ["share_a", "share_b"])
    return joined.withColumn("delta", F.col("share_b") - F.col("share_a"))
