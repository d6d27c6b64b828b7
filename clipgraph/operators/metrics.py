"""Confusion roll-ups, scores, correlations, agreement and intervals."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.ordered import average_ranks, prefix_counts, quantiles, with_row_index
from clipgraph.session import cut, join_small, keys

E = A.E


def confusion(df: DataFrame, y: str, pred: str, by=None, weight: str | None = None) -> DataFrame:
    """(group, y, pred, n)"""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys(by), y, pred).agg(n.alias("n"))


def prf(conf: DataFrame, by=None, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class: support, predicted, tp, precision, recall, f1 (0 where undefined). One shuffle of the count table."""
    by = keys(by)
    sides = F.explode(E(f"array(named_struct('c', {y}, 's', n, 'p', 0 * n, 't', IF({y} = {pred}, n, 0 * n)), "
                        f"named_struct('c', {pred}, 's', 0 * n, 'p', n, 't', 0 * n))")).alias("_x")
    agg = conf.select(*by, sides).groupBy(*by, F.col("_x.c").alias("class")).agg(
        F.sum("_x.s").alias("support"), F.sum("_x.p").alias("predicted"), F.sum("_x.t").alias("tp"))
    return agg.selectExpr(*by, "class", "support", "predicted", "tp",
                          "IF(predicted > 0, tp / predicted, 0D) AS precision",
                          "IF(support > 0, tp / support, 0D) AS recall",
                          "IF(support + predicted > 0, 2 * tp / (support + predicted), 0D) AS f1")


def macro_f1(scores: DataFrame, n_classes: int | None, by=None, skip_null: bool = False) -> DataFrame:
    """Mean F1 over a fixed class list (absent classes count as 0), or over the present classes when None."""
    by = keys(by)
    rows = scores.where("class <> 0") if skip_null else scores
    if n_classes is None:
        return rows.where("support + predicted > 0").groupBy(*by).agg(F.avg("f1").alias("f1"))
    return rows.groupBy(*by).agg((F.sum("f1") / (n_classes - int(skip_null))).alias("f1"))


def score(df: DataFrame, y: str, pred: str, n_classes: int | None, by=None, skip_null: bool = False) -> DataFrame:
    return macro_f1(prf(confusion(df, y, pred, by), by, y, pred), n_classes, by, skip_null)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    pivoted = df.groupBy(a).pivot(b, list(values)) if values is not None else df.groupBy(a).pivot(b)
    return pivoted.count().na.fill(0)


def loo_percentile(counts: DataFrame, unit: str, value: str, qs: Sequence[float]) -> DataFrame:
    """Percentiles of the values of all *other* units: (unit, q, value).

    The pooled values are numbered once. The order statistic of the others at position j is found from how many own
    values lie at or below it, so no unit is paired with the other units' rows.
    """
    rows = with_row_index(counts.select(unit, F.col(value).cast("double").alias("_v")), None, ["_v", unit],
                          out="_i", size="_n").withColumn("_one", F.lit(1))
    own = rows.groupBy(unit).agg(E("array_sort(collect_list(_i))").alias("_own"), F.first("_n").alias("_n"))
    grid = E("explode(array(" + ", ".join(A.num(q) for q in qs) + "))").alias("q")
    # position j among the others = pooled position j + (number of own positions p_m with p_m - m <= j)
    want = own.select(unit, "_own", "_n", grid) \
        .withColumn("_pos", E("q * (_n - size(_own) - 1)")) \
        .withColumn("_side", E("explode(array(floor(_pos), ceil(_pos)))")) \
        .withColumn("_w", E("IF(floor(_pos) = ceil(_pos), 0.5D, IF(_side = floor(_pos), 1 - (_pos - floor(_pos)), "
                            "_pos - floor(_pos)))")) \
        .withColumn("_i", E("_side + size(filter(_own, (p, m) -> p - m <= _side))"))
    return want.join(rows.select("_i", "_v"), "_i").groupBy(unit, "q").agg(F.sum(E("_v * _w")).alias(value))


def wavg(df: DataFrame, value: str, weight: str, by=None, out: str = "value") -> DataFrame:
    return df.groupBy(*keys(by)).agg(
        E(f"sum({value} * {weight}) / nullif(CAST(sum({weight}) AS DOUBLE), 0D)").alias(out))


def mode_and_purity(df: DataFrame, by, pred: str, out: str = "mode") -> DataFrame:
    """Most frequent value (lowest on ties), its share and the row count per group."""
    by = keys(by)
    counts = df.groupBy(*by, pred).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(
        E(f"max_by({pred}, struct(_c, -{pred}))").alias(out),
        (F.max("_c") / F.sum("_c")).alias("purity"), F.sum("_c").alias("n"))


def segment_accuracy(df: DataFrame, seg, y: str, preds: Sequence[str], min_len: int = 1) -> DataFrame:
    """Mode of every prediction column per segment, next to the segment's label."""
    seg = keys(seg)
    out = df.groupBy(*seg).agg(F.min(y).alias(y), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_len)
    for p in preds:
        out = out.join(mode_and_purity(df, seg, p, out=f"mode_{p}").drop("purity", "n"), seg)
    return out


def error_attribution(segments: DataFrame, y: str, base: str, a: str, b: str, by=None) -> DataFrame:
    """Among segments the base gets wrong: how many are right by a only, b only, both or neither."""
    ok = lambda c: f"{c} = {y}"
    return segments.where(f"{base} <> {y}").groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("wrong"),
        F.count_if(E(f"{ok(a)} AND NOT {ok(b)}")).alias("only_a"),
        F.count_if(E(f"{ok(b)} AND NOT {ok(a)}")).alias("only_b"),
        F.count_if(E(f"{ok(a)} AND {ok(b)}")).alias("both"),
        F.count_if(E(f"NOT ({ok(a)}) AND NOT ({ok(b)})")).alias("neither"))


def flow_table(df: DataFrame, a: str, b: str, n: int | None = None) -> DataFrame:
    """Label changes (from, to, count), the most frequent n."""
    flow = df.where(F.col(a) != F.col(b)).groupBy(F.col(a).alias("from"), F.col(b).alias("to")) \
             .agg(F.count(F.lit(1)).alias("n"))
    return flow.orderBy(F.desc("n"), "from", "to").limit(n) if n else flow


def share_report(df: DataFrame, pred: str, n_classes: int, by=None) -> DataFrame:
    """Null rate, number of classes with at least 1 %, smallest non-null share, per group."""
    by = keys(by)
    cells = ", ".join(f"avg(CAST({pred} = {c} AS INT))" for c in range(n_classes))
    shares = df.groupBy(*by).agg(E(f"array({cells})").alias("share"))
    return shares.select(*by, E("share[0]").alias("null_rate"),
                         E("size(filter(share, x -> x >= 0.01D))").alias("n_used"),
                         E("array_min(slice(share, 2, size(share) - 1))").alias("min_share"))


def spread_ratio(rates: DataFrame, a: str, b: str) -> DataFrame:
    """Range of a group rate over the range of a second one, and their correlation."""
    return rates.agg(((F.max(a) - F.min(a)) / (F.max(b) - F.min(b) + 1e-9)).alias("spread_ratio"),
                     E(A.corr(a, b)).alias("rate_corr"))


def nmi(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Normalised mutual information, arithmetic-mean normalisation."""
    by = keys(by)
    cells = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("nij"))
    pa = cells.groupBy(*by, a).agg(F.sum("nij").alias("ni"))
    pb = cells.groupBy(*by, b).agg(F.sum("nij").alias("nj"))
    n = cells.groupBy(*by).agg(F.sum("nij").alias("n"))
    joined = cells.join(pa, [*by, a]).join(pb, [*by, b])
    joined = joined.join(n, by) if by else joined.crossJoin(F.broadcast(n))
    mi = F.sum(E("nij / n * ln(nij * n / (ni * nj))"))
    # H(a) = -sum nij/n ln(ni/n): every row of the margin is reached through its cells
    ha, hb = -F.sum(E("nij / n * ln(ni / n)")), -F.sum(E("nij / n * ln(nj / n)"))
    return joined.groupBy(*by).agg(mi.alias("_mi"), ha.alias("_ha"), hb.alias("_hb")) \
                 .select(*by, E("IF(_ha + _hb = 0, 1D, _mi / ((_ha + _hb) / 2))").alias("nmi"))


def pearson(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    return df.groupBy(*keys(by)).agg(E(A.corr(a, b)).alias("pearson"))


def spearman(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    by = keys(by)
    ranked = average_ranks(average_ranks(df.select(*by, a, b), a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(E(A.corr("_ra", "_rb")).alias("spearman"))


def confusability(conf: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Symmetric class-pair confusion rate (a, b, rate): mean of both row-normalised off-diagonal cells."""
    rows = conf.groupBy(y).agg(F.sum("n").alias("_t"))
    rate = conf.join(rows, y).where(F.col(y) != F.col(pred)).select(
        F.least(y, pred).alias("a"), F.greatest(y, pred).alias("b"), (F.col("n") / F.col("_t") / 2).alias("r"))
    half = rate.groupBy("a", "b").agg(F.sum("r").alias("rate"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "rate"))


def auc(df: DataFrame, score: str, y: str, by=None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve from weight totals below each distinct score; ties count half."""
    by = keys(by)
    w = weight or "1D"
    cells = df.groupBy(*by, score).agg(F.sum(E(f"IF({y} = 1, {w}, 0D)")).alias("_p"),
                                       F.sum(E(f"IF({y} = 1, 0D, {w})")).alias("_q"))
    below = prefix_counts(cells, by, score, "_q", "_below")
    return below.groupBy(*by).agg(
        E("sum(_p * (_below + 0.5D * _q)) / nullif(sum(_p) * sum(_q), 0D)").alias("auc"))


def pooled_r2(df: DataFrame, y: str, yhat: str, by=None) -> DataFrame:
    """1 - sum of squared residuals / sum of squares about the group mean, pooled over groups."""
    by = keys(by)
    g = df.groupBy(*by).agg(F.sum(E(f"pow({y} - {yhat}, 2)")).alias("e"), F.var_pop(y).alias("v"),
                            F.count(F.lit(1)).alias("n"))
    return g.agg(E("1 - sum(e) / nullif(sum(v * n), 0D)").alias("r2"))


def class_mean(df: DataFrame, value: str, y: str, by=None, skip: int | None = 0) -> DataFrame:
    """Mean per class, then over classes."""
    by = keys(by)
    rows = df if skip is None else df.where(F.col(y) != skip)
    return rows.groupBy(*by, y).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias(value))


def rollup_scores(scores: DataFrame, levels: Sequence[str], value: str = "f1") -> DataFrame:
    """Mean and population standard deviation at every level of a hierarchy, and overall."""
    return scores.rollup(*levels).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                      F.count(F.lit(1)).alias("n"))


def cell_shares(cells: DataFrame, by, cls: str, min_share: float = 0.002) -> DataFrame:
    """Share of each class in every image cell; classes whose overall share stays below the limit are left out."""
    by = keys(by)
    counts = cells.groupBy(*by, cls).agg(F.count(F.lit(1)).alias("_n"))
    per_cell = counts.groupBy(*by).agg(F.sum("_n").alias("_t"))
    per_cls = counts.groupBy(cls).agg(F.sum("_n").alias("_c"))
    total = counts.agg(F.sum("_n").alias("_all"))
    kept = per_cls.crossJoin(F.broadcast(total)).where(F.col("_c") / F.col("_all") > min_share).select(cls)
    return counts.join(per_cell, by).join(kept, cls).select(*by, cls, (F.col("_n") / F.col("_t")).alias("frac"))


def threshold_scan(df: DataFrame, score: str, p: str, y: str, n_classes: int, qs: Sequence[float]) -> DataFrame:
    """Macro-F1 of the null gate at every quantile of a score: (q, threshold, f1). Thresholds travel as literals."""
    from clipgraph.operators.probs import null_gate, with_grid

    # one row per quantile
    found = sorted((r["q"], r[score]) for r in quantiles(df.select(score), None, score, qs).collect())
    rows = with_grid(df.select(score, p, y), [{"q": q, "threshold": float(t)} for q, t in found])
    pred = null_gate(rows, score, "threshold", p)
    out = macro_f1(prf(confusion(pred, y, "pred", ["q", "threshold"]), ["q", "threshold"], y, "pred"), n_classes,
                   ["q", "threshold"])
    return out


def top_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def group_window(df: DataFrame, value: str, fn: str, by, out: str) -> DataFrame:
    """A group aggregate on every row. A join of the aggregate, so a hot group is not sorted in one task."""
    by = keys(by)
    return join_small(df, df.groupBy(*by).agg(E(f"{fn}({value})").alias(out)), by)


def bootstrap_ci(conf: DataFrame, by: str, reps: int, seed: int = 0, y: str = "y", pred: str = "pred",
                 config: Sequence[str] = (), lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Group bootstrap of the macro-F1 over present classes: (config, lo, hi, mean) over ``reps`` replicates.

    Every replicate draws as many groups as there are, with replacement, by the md5 of seed:replicate:draw.
    """
    config = list(config)
    scores = bootstrap_scores(conf, by, reps, seed, y, pred, config)
    q = quantiles(scores, config, "f1", [lo, hi])
    ends = q.groupBy(*config).agg(F.max(F.when(F.col("q") == lo, F.col("f1"))).alias("lo"),
                                  F.max(F.when(F.col("q") == hi, F.col("f1"))).alias("hi"))
    mean = scores.groupBy(*config).agg(F.avg("f1").alias("mean"))
    return ends.join(mean, config) if config else ends.crossJoin(mean)


def bootstrap_draws(groups: DataFrame, by: str, reps: int, seed: int) -> DataFrame:
    """(rep, group, k): how often each group was drawn in each replicate."""
    indexed = with_row_index(groups.select(by).distinct(), None, [by], out="_g", size="_n")
    draws = indexed.select(E(f"explode(sequence(0, {reps - 1}))").alias("rep"), F.col("_g").alias("_d"), "_n")
    draws = draws.select("rep", E(f"pmod(CAST(conv(substr(md5(concat_ws(':', {seed}, rep, _d)), 1, 8), 16, 10) AS BIGINT), _n)").alias("_g"))
    return draws.groupBy("rep", "_g").agg(F.count(F.lit(1)).alias("k")) \
                .join(indexed.select(by, "_g"), "_g").select("rep", by, "k")


def bootstrap_scores(conf: DataFrame, by: str, reps: int, seed: int = 0, y: str = "y", pred: str = "pred",
                     config: Sequence[str] = ()) -> DataFrame:
    draws = bootstrap_draws(conf, by, reps, seed)
    weighted = conf.join(draws, by).groupBy(*config, "rep", y, pred).agg(F.sum(E("n * k")).alias("n"))
    return macro_f1(prf(weighted, [*config, "rep"], y, pred), None, [*config, "rep"])


def bootstrap_paired(conf: DataFrame, by: str, reps: int, config: str, pairs: Sequence[tuple[str, str]], seed: int = 0, y: str = "y",
                     pred: str = "pred", lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Gain in macro-F1 from one configuration to another: (a, b, diff, lo, hi, improved, groups), one row per pair (a, b).

    All configurations see the same draws, so a replicate gives one difference of each pair. ``diff`` is the gain over the whole table,
    ``improved`` the number of groups that score higher under b, ``groups`` those scored under both. A configuration without rows has nulls.
    """
    names = sorted({c for pair in pairs for c in pair})

    def gains(scores: DataFrame, own: list[str]) -> DataFrame:
        wide = scores.groupBy(*own).pivot(config, names).agg(F.first("f1"))
        each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{b}`") - F.col(f"`{a}`")).alias("diff")) for a, b in pairs]
        return wide.select(*own, F.explode(F.array(*each)).alias("_p")).select(*own, "_p.*")

    def scored(own: list[str]) -> DataFrame:
        sums = conf.groupBy(config, *own, y, pred).agg(F.sum("n").alias("n"))
        return macro_f1(prf(sums, [config, *own], y, pred), None, [config, *own])

    draws = cut(gains(bootstrap_scores(conf, by, reps, seed, y, pred, [config]), ["rep"]))
    q = quantiles(draws, ["a", "b"], "diff", [lo, hi])
    ends = q.groupBy("a", "b").agg(F.max(F.when(F.col("q") == lo, F.col("diff"))).alias("lo"), F.max(F.when(F.col("q") == hi, F.col("diff"))).alias("hi"))
    own = gains(scored([by]), [by]).groupBy("a", "b").agg(F.count_if(F.col("diff") > 1e-12).alias("improved"), F.count("diff").alias("groups"))
    return gains(scored([]), []).join(ends, ["a", "b"], "left").join(own, ["a", "b"], "left")


def bootstrap_auc(pairs: DataFrame, a: str, b: str, score: str, y: str, reps: int, seed: int = 0) -> DataFrame:
    """AUC over pairs of units under a unit bootstrap: a pair counts k_a * k_b times. (rep, auc)"""
    units = pairs.select(F.col(a).alias("_u")).union(pairs.select(F.col(b).alias("_u")))
    draws = bootstrap_draws(units, "_u", reps, seed)
    ka = draws.select("rep", F.col("_u").alias(a), F.col("k").alias("_ka"))
    kb = draws.select("rep", F.col("_u").alias(b), F.col("k").alias("_kb"))
    weighted = pairs.join(ka, a).join(kb, ["rep", b]).withColumn("_w", E("CAST(_ka * _kb AS DOUBLE)"))
    return auc(weighted, score, y, ["rep"], "_w")


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of paired differences (zeros left out), sign counts and the normal score."""
    diff = df.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    ranked = average_ranks(diff, "_abs", None, "_r")
    return ranked.agg(F.sum(E("IF(_d > 0, _r, 0D)")).alias("w_plus"), F.sum(E("IF(_d < 0, _r, 0D)")).alias("w_minus"),
                      F.count_if(E("_d > 0")).alias("n_plus"), F.count_if(E("_d < 0")).alias("n_minus")) \
                 .withColumn("_n", (F.col("n_plus") + F.col("n_minus")).cast("double")) \
                 .selectExpr("w_plus", "w_minus", "n_plus", "n_minus",
                             # as doubles: the product of three counts leaves the range of LONG from 1.7 million rows on
                             "(w_plus - _n * (_n + 1) / 4) / sqrt(_n * (_n + 1) * (2 * _n + 1) / 24) AS z")


def paired_diff(scores: DataFrame, ref: str, config: str = "config", seed: str = "seed",
                value: str = "f1") -> DataFrame:
    """Mean difference to a chosen configuration over seeds, and whether all seeds agree in sign."""
    base = scores.where(F.col(config) == ref).select(seed, F.col(value).alias("_ref"))
    d = scores.join(base, seed).withColumn("_d", F.col(value) - F.col("_ref"))
    return d.groupBy(config).agg(F.avg(value).alias("mean"), F.avg("_d").alias("diff"),
                                 (F.bool_and(F.col("_d") > 0) | F.bool_and(F.col("_d") < 0)).alias("same_sign"))
