"""Diagnostics of graphs and predictions. All are aggregations over the edge table with both ends' columns attached."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import metrics as M
from clipgraph.operators.ordered import quantiles
from clipgraph.session import cut, join_small, keys

E = A.E


def with_ends(edges: DataFrame, rows: DataFrame, columns: Sequence[str], ident: str = "clip_id") -> DataFrame:
    """Edges with the columns of their source (s_) and target (t_) rows."""
    s = rows.select(F.col(ident).alias("src"), *[F.col(c).alias(f"s_{c}") for c in columns])
    t = rows.select(F.col(ident).alias("dst"), *[F.col(c).alias(f"t_{c}") for c in columns])
    return edges.join(s, "src").join(t, "dst")


def _same(c: str) -> str:
    return f"CAST(s_{c} = t_{c} AS DOUBLE)"


def neighbor_stats(edges: DataFrame, rows: DataFrame, label: str = "label", sensor: str | None = "sensor",
                   by=None) -> DataFrame:
    """Share of edges whose ends agree in label and in sensor."""
    cols = [label] + ([sensor] if sensor else [])
    ends = with_ends(edges, rows, cols)
    aggs = [F.avg(E(_same(label))).alias("purity")]
    if sensor:
        aggs.append(F.avg(E(_same(sensor))).alias("same_sensor"))
    return ends.groupBy(*keys(by)).agg(*aggs)


def purity_by_time(edges: DataFrame, rows: DataFrame, gaps: Sequence[float], label: str = "label", sec: str = "sec",
                   by=None) -> DataFrame:
    """Purity of edges further apart than each gap, their share, and the median gap of all edges."""
    by = keys(by)
    ends = with_ends(edges, rows, [label, sec]).withColumn("_dt", E(f"CAST(abs(s_{sec} - t_{sec}) AS DOUBLE)"))
    aggs = [F.avg(E(_same(label))).alias("purity")]
    for g in gaps:
        far = f"_dt > {A.num(g)}"
        aggs += [F.avg(E(f"IF({far}, {_same(label)}, NULL)")).alias(f"purity_gt_{g:g}"),
                 F.avg(E(f"CAST({far} AS DOUBLE)")).alias(f"share_gt_{g:g}")]
    out = ends.groupBy(*by).agg(*aggs)
    med = quantiles(ends, by, "_dt", [0.5]).select(*by, F.col("_dt").alias("median_gap"))
    return out.join(med, by) if by else out.crossJoin(med)


def shifted_purity(edges: DataFrame, rows: DataFrame, shifts: Sequence[int], rec: str = "rec", sec: str = "sec",
                   label: str = "label", ident: str = "clip_id") -> DataFrame:
    """Purity under labels taken ``shift`` seconds later, over edges where both ends have one."""
    from clipgraph.operators.windows import label_at_shift

    moved = label_at_shift(rows.select(ident, rec, sec, label), rec, shifts, sec, label).select(ident, "shift", "shifted_label")
    s = moved.select(F.col(ident).alias("src"), "shift", F.col("shifted_label").alias("_a"))
    t = moved.select(F.col(ident).alias("dst"), "shift", F.col("shifted_label").alias("_b"))
    return edges.select("src", "dst").join(s, "src").join(t, ["dst", "shift"]) \
                .groupBy("shift").agg(F.avg(E("CAST(_a = _b AS DOUBLE)")).alias("purity"), F.count(F.lit(1)).alias("n"))


def segment_purity(edges: DataFrame, rows: DataFrame, label: str = "label", seg: str = "seg", by=None) -> DataFrame:
    ends = with_ends(edges, rows, [label, seg])
    return ends.groupBy(*keys(by)).agg(
        F.avg(E(_same(label))).alias("purity"), F.avg(E(_same(seg))).alias("same_segment"),
        F.avg(E(f"IF(s_{label} = t_{label}, {_same(seg)}, NULL)")).alias("same_segment_given_label"))


def cross_purity(edges: DataFrame, rows: DataFrame, label: str = "label", by: str = "grp") -> DataFrame:
    """Purity of edges into other groups against the chance level, the sum of squared label shares."""
    ends = with_ends(edges, rows, [label, by])
    pure = ends.groupBy(F.col(f"s_{by}").alias(by)).agg(F.avg(E(_same(label))).alias("purity"))
    counts = rows.groupBy(by, label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(label).agg(F.sum("_n").alias("_t"))
    n = counts.groupBy(by).agg(F.sum("_n").alias("_gn"))
    all_n = counts.agg(F.sum("_n").alias("_all"))
    # label shares among the other groups, weighted by the group's own label mix
    mix = counts.join(total, label).join(n, by).crossJoin(F.broadcast(all_n))
    chance = mix.groupBy(by).agg(F.sum(E("_n / _gn * (_t - _n) / (_all - _gn)")).alias("chance"))
    return pure.join(chance, by)


def hubness(edges: DataFrame, rows: DataFrame, k: int, pred: str = "pred", label: str = "label", by: str = "grp",
            ident: str = "clip_id") -> DataFrame:
    """Skewness of in-degrees, largest in-degree / k, error excess of the top 5 % in-degree rows."""
    indeg = edges.groupBy(F.col("dst").alias(ident)).agg(F.count(F.lit(1)).alias("_in"))
    deg = rows.select(by, ident, E(f"CAST({pred} <> {label} AS DOUBLE)").alias("_err")).join(indeg, ident, "left") \
              .withColumn("deg", E("CAST(coalesce(_in, 0) AS DOUBLE)"))
    level = quantiles(deg, by, "deg", [0.95]).select(by, F.col("deg").alias("_p95"))
    mean = deg.groupBy(by).agg(F.avg("deg").alias("_mu"), F.stddev_pop("deg").alias("_sd"))
    joined = join_small(deg, level.join(mean, by), [by])
    return joined.groupBy(by).agg(
        E("avg(pow(deg - _mu, 3)) / (pow(first(_sd), 3) + 1e-9D)").alias("skew"),
        (F.max("deg") / k).alias("max_over_k"),
        E("avg(IF(deg >= _p95, _err, NULL)) - avg(_err)").alias("hub_error_excess"))


def rescue_rate(edges: DataFrame, rows: DataFrame, pred: str = "pred", label: str = "label", by=None) -> DataFrame:
    """Among same-label edges of wrongly predicted rows: the share whose neighbour is right."""
    ends = with_ends(edges, rows, [pred, label]).where(f"s_{pred} <> s_{label} AND s_{label} = t_{label}")
    return ends.groupBy(*keys(by)).agg(F.avg(E(f"CAST(t_{pred} = t_{label} AS DOUBLE)")).alias("rescue"),
                                       F.count(F.lit(1)).alias("n"))


def cross_share(edges: DataFrame, rows: DataFrame, label: str = "label", by=None) -> DataFrame:
    """Share of mutual edges between different labels."""
    ends = with_ends(edges.where("mutual"), rows, [label])
    return ends.groupBy(*keys(by)).agg((1 - F.avg(E(_same(label)))).alias("cross_share"))


def class_purity(edges: DataFrame, rows: DataFrame, label: str = "label", skip: int | None = 0) -> DataFrame:
    """Purity of mutual edges per class of the source."""
    ends = with_ends(edges.where("mutual"), rows, [label])
    out = ends.groupBy(F.col(f"s_{label}").alias(label)).agg(F.avg(E(_same(label))).alias("purity"))
    return out if skip is None else out.where(F.col(label) != skip)


def rival_stats(edges: DataFrame, rows: DataFrame, n_classes: int, label: str = "label", p: str = "p",
                ident: str = "clip_id") -> DataFrame:
    """Per row over mutual edges: purity, share and concentration of the strongest other class, and whether the
    neighbours' majority and their mean probability point at the true class."""
    s = rows.select(F.col(ident).alias("src"), F.col(label).alias("_y"))
    t = rows.select(F.col(ident).alias("dst"), F.col(label).alias("_ty"), F.col(p).alias("_q"))
    kept = edges.where("mutual").select("src", "dst").join(t, "dst")
    counts = "array(" + ", ".join(f"count_if(_ty = {c})" for c in range(n_classes)) + ")"
    per = kept.groupBy("src").agg(E(counts).alias("_h"), E(A.weighted_sums("_q", n_classes, "1D")).alias("_m"))
    out = s.join(per, "src", "left")
    others = A.each("_ho", lambda x: x)
    out = out.withColumn("_ho", E("transform(_h, (x, c) -> IF(c = _y, 0L, x))")).withColumn("_ho", E(others))
    n, rest = "greatest(aggregate(_h, 0L, (s, x) -> s + x), 1L)", "aggregate(_ho, 0L, (s, x) -> s + x)"
    return out.select(
        F.col("src").alias(ident), E(f"coalesce(_h[_y] / {n}, 0D)").alias("purity"),
        E(f"coalesce(array_max(_ho) / {n}, 0D)").alias("rival"),
        E(f"IF({rest} > 0, array_max(_ho) / {rest}, NULL)").alias("concentration"),
        E(f"coalesce({A.argmax('_h')} = _y, false)").alias("majority_correct"),
        E(f"coalesce({A.argmax('_m')} = _y, false)").alias("mean_p_correct"))


def hard_edges(edges: DataFrame, rows: DataFrame, conf: DataFrame, label: str = "label",
               ident: str = "clip_id") -> DataFrame:
    """Per row: confusability summed over cross-class mutual edges / degree, its mean over those edges, their share."""
    ends = with_ends(edges.where("mutual"), rows, [label])
    joined = ends.join(conf.select(F.col("a").alias(f"s_{label}"), F.col("b").alias(f"t_{label}"), "rate"),
                       [f"s_{label}", f"t_{label}"], "left")
    cross = f"s_{label} <> t_{label}"
    return joined.groupBy(F.col("src").alias(ident)).agg(
        E(f"sum(IF({cross}, coalesce(rate, 0D), 0D)) / count(*)").alias("hard"),
        E(f"avg(IF({cross}, coalesce(rate, 0D), NULL))").alias("mean_rate"),
        E(f"avg(CAST({cross} AS DOUBLE))").alias("cross_share"))


def same_error(edges: DataFrame, rows: DataFrame, label: str = "label", p: str = "p",
               ident: str = "clip_id") -> DataFrame:
    """Means over rows: purity, the neighbours' probability of the row's true class, and, for wrong rows, the share
    of neighbours with the same prediction. Rows without mutual edges count as 0."""
    base = rows.select(ident, label, p, E(A.argmax(p)).alias("_a"))
    ends = with_ends(edges.where("mutual"), base, [label, p, "_a"])
    per = ends.groupBy("src").agg(F.avg(E(_same(label))).alias("_pur"), F.avg(E(f"t_{p}[s_{label}]")).alias("_sig"),
                                  F.avg(E(_same("_a"))).alias("_err"))
    full = base.join(per.withColumnRenamed("src", ident), ident, "left").na.fill(0.0, ["_pur", "_sig", "_err"])
    return full.agg(F.avg("_pur").alias("purity"), F.avg("_sig").alias("signal"),
                    F.avg(E(f"IF(_a <> {label}, _err, NULL)")).alias("same_error"))


def neighbor_vs_confusion(edges: DataFrame, rows: DataFrame, n_classes: int, pred: str = "pred",
                          label: str = "label") -> DataFrame:
    """Correlation of the off-diagonal cells of the row-normalised neighbour-label and confusion matrices, and of a
    null matrix that keeps only the purity (its expectation, so no draw is needed)."""
    classes = f"explode(sequence(0, {n_classes - 1}))"
    grid = rows.sparkSession.range(1).select(E(classes).alias("a")).select("a", E(classes).alias("b"))
    nb = with_ends(edges, rows, [label]).groupBy(F.col(f"s_{label}").alias("a"), F.col(f"t_{label}").alias("b")) \
        .agg(F.count(F.lit(1)).alias("_x"))
    cf = rows.groupBy(F.col(label).alias("a"), F.col(pred).alias("b")).agg(F.count(F.lit(1)).alias("_z"))

    def shares(counts, v, out):
        t = counts.groupBy("a").agg(F.sum(v).alias("_t"))
        return counts.join(t, "a").select("a", "b", (F.col(v) / F.col("_t")).alias(out))

    cells = grid.join(shares(nb, "_x", "nbr"), ["a", "b"], "left").join(shares(cf, "_z", "conf"), ["a", "b"], "left") \
                .na.fill(0.0)
    prior = rows.groupBy(F.col(label).alias("b")).agg(F.count(F.lit(1)).alias("_nb"))
    n = rows.agg(F.count(F.lit(1)).alias("_all"))
    pur = with_ends(edges, rows, [label]).agg(F.avg(E(_same(label))).alias("_pur"))
    own = prior.select(F.col("b").alias("a"), F.col("_nb").alias("_na"))
    cells = cells.join(prior, "b", "left").join(own, "a", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(pur)) \
        .na.fill(0, ["_nb", "_na"]).withColumn("null", E("(1 - _pur) * _nb / greatest(_all - _na, 1)"))
    return cells.where("a <> b").agg(E(A.corr("nbr", "conf")).alias("r"), E(A.corr("`null`", "conf")).alias("r_null"))


def isolation(edges: DataFrame, rows: DataFrame, pred: str = "pred", label: str = "label", by=None,
              ident: str = "clip_id") -> DataFrame:
    """Mean number of mutual edges, share of rows without any, also among wrongly predicted rows."""
    deg = edges.where("mutual").groupBy(F.col("src").alias(ident)).agg(F.count(F.lit(1)).alias("_d"))
    joined = rows.join(deg, ident, "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    return joined.groupBy(*keys(by)).agg(
        F.avg("_d").alias("mean_degree"), F.avg(E("CAST(_d = 0 AS DOUBLE)")).alias("isolated"),
        F.avg(E(f"IF({pred} <> {label}, CAST(_d = 0 AS DOUBLE), NULL)")).alias("isolated_wrong"))


def transitions(a: DataFrame, b: DataFrame, label: str = "label", pred: str = "pred", ident: str = "clip_id",
                by=None) -> DataFrame:
    """Rows fixed and broken by the second system, and the difference."""
    joined = a.select(*keys(by), ident, label, F.col(pred).alias("_a")).join(b.select(ident, F.col(pred).alias("_b")), ident)
    return joined.groupBy(*keys(by)).agg(
        F.count_if(E(f"_a <> {label} AND _b = {label}")).alias("fixed"),
        F.count_if(E(f"_a = {label} AND _b <> {label}")).alias("broken")) \
        .withColumn("net", F.col("fixed") - F.col("broken"))


def surrounding_class(edges: DataFrame, rows: DataFrame, label: str = "label", ident: str = "clip_id") -> DataFrame:
    """The most frequent other class among each row's mutual neighbours: (clip, label, dominant, share)."""
    ends = with_ends(edges.where("mutual"), rows, [label])
    counts = ends.groupBy("src", f"s_{label}", f"t_{label}").agg(F.count(F.lit(1)).alias("_n"))
    other = f"IF(s_{label} = t_{label}, -1L, _n)"
    return counts.groupBy(F.col("src").alias(ident), F.col(f"s_{label}").alias(label)).agg(
        E(f"max_by(t_{label}, struct({other}, -t_{label}))").alias("dominant"),
        E(f"max({other}) / sum(_n)").alias("share")).where("share > 0")


def agreement(df: DataFrame, pred: str, judge: str, n_classes: int, by: str = "grp") -> DataFrame:
    """Label-free report against an independent judge: macro-F1, NMI, null rates, class use and spread."""
    f1 = M.score(df, judge, pred, n_classes).withColumnRenamed("f1", "agree_f1")
    out = f1.crossJoin(M.nmi(df, pred, judge).withColumnRenamed("nmi", "agree_nmi"))
    out = out.crossJoin(M.share_report(df, pred, n_classes))
    rates = df.groupBy(by).agg(F.avg(E(f"CAST({pred} = 0 AS DOUBLE)")).alias("_a"),
                               F.avg(E(f"CAST({judge} = 0 AS DOUBLE)")).alias("_b"))
    judge_rate = df.agg(F.avg(E(f"CAST({judge} = 0 AS DOUBLE)")).alias("judge_null_rate"))
    return out.crossJoin(M.spread_ratio(rates, "_a", "_b")).crossJoin(judge_rate)  # all sides are single rows


def group_report(rows: DataFrame, edges: DataFrame, n_classes: int | None, base: str = "base_pred",
                 final: str = "pred", label: str = "label", by: str = "grp") -> DataFrame:
    """Per group: score of the base and final predictions, graph purity, and null rate."""
    b = M.score(rows, label, base, n_classes, by).withColumnRenamed("f1", "base_f1")
    f = M.score(rows, label, final, n_classes, by).withColumnRenamed("f1", "final_f1")
    pur = with_ends(edges, rows, [label, by]).groupBy(F.col(f"s_{by}").alias(by)).agg(F.avg(E(_same(label))).alias("purity"))
    null = rows.groupBy(by).agg(F.avg(E(f"CAST({label} = 0 AS DOUBLE)")).alias("null_rate"))
    return b.join(f, by).join(pur, by).join(null, by)


def per_class_report(rows: DataFrame, preds: Sequence[str], label: str = "label", by=None) -> DataFrame:
    """Per class (and key): F1 of several predictions and the best of them."""
    by = keys(by)
    out = None
    for p in preds:
        part = M.prf(M.confusion(rows, label, p, by), by, label, p).select(*by, "class", F.col("f1").alias(f"f1_{p}"))
        out = part if out is None else out.join(part, [*by, "class"], "full_outer")
    out = out.na.fill(0.0, [f"f1_{p}" for p in preds])  # a null label stays a class of its own
    return out.withColumn("best", F.greatest(*[f"f1_{p}" for p in preds]) if len(preds) > 1 else F.col(f"f1_{preds[0]}"))


def per_class_sides(rows: DataFrame, preds: Sequence[str], side: str, sides: Sequence[str], n_classes: int, label: str = "label") -> DataFrame:
    """``per_class_report`` over a fixed class list, with the recall of the first prediction on each side, and the means as a row of null class.

    A class without rows on a side has recall 0 there. Rows with a null label or of another side count in the F1 only.
    """
    hit = (F.col(label) == F.col(preds[0])).cast("double")
    recalls = rows.groupBy(F.col(label).alias("class")).agg(*[F.avg(F.when(F.col(side) == v, hit)).alias(f"recall_{v}") for v in sides])
    listed = rows.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    full = cut(listed.join(per_class_report(rows, preds, label), "class", "left").join(recalls, "class", "left").na.fill(0.0))
    return full.unionByName(full.agg(F.lit(None).cast("int").alias("class"), *[F.avg(c).alias(c) for c in full.columns if c != "class"]))


def label_sensitivity(rows: DataFrame, variants: dict[str, DataFrame], n_classes: int, label: str = "label",
                      pred: str = "pred") -> DataFrame:
    """The same predictions scored under altered row sets or labels: (variant, f1)."""
    tagged = rows.select(label, pred, F.lit("as is").alias("variant"))
    for name, df in variants.items():
        tagged = tagged.unionByName(df.select(label, pred, F.lit(name).alias("variant")))
    return M.score(tagged, label, pred, n_classes, "variant")
