"""Probability-table and decision queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import constraints as C
from clipgraph.operators import metrics as M
from clipgraph.operators import probs as P
from clipgraph.operators.filters import sample_per_group
from clipgraph.registry.core import (N_CLASSES, E, cte, edges, emb, evidence, kept, labels_of, long, predictions, probs, query, r,
                                     rounded, sharpen_cte, pool_cte, with_ctes)
from clipgraph.registry.graphs import pv_sql, runs

# rows with mass only in some classes, one row in seven without any
cte("gaps", "SELECT grp, clip_id, c, CASE WHEN clip_id % 7 = 0 OR (clip_id + c) % 3 = 0 THEN 0 ELSE v END AS v FROM p", "p")


def gaps(spark, d):
    return probs(spark, d).withColumn("p", E("transform(p, (x, c) -> IF(clip_id % 7 = 0 OR (clip_id + c) % 3 = 0, 0D, x))"))


@query("normalize_zero_fallback", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('CASE WHEN s > 0 THEN v / s ELSE 0 END')} AS v FROM (SELECT *, sum(v) OVER (PARTITION BY clip_id) AS s "
    f"FROM gaps)", "gaps"))
def _(spark, d):
    return long(P.normalize_probs(gaps(spark, d)))


@query("normalize_uniform_fallback", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('CASE WHEN s > 0 THEN v / s ELSE 0.1 END')} AS v FROM (SELECT *, sum(v) OVER (PARTITION BY clip_id) "
    f"AS s FROM gaps)", "gaps"))
def _(spark, d):
    return long(P.normalize_probs(gaps(spark, d), fallback="uniform"))


@query("drop_empty_rows", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('v / s')} AS v FROM (SELECT *, sum(v) OVER (PARTITION BY clip_id) AS s FROM gaps) WHERE s > 1e-6", "gaps"))
def _(spark, d):
    return long(P.drop_empty(gaps(spark, d)))


def models(spark, d):
    return runs(spark, d).withColumnRenamed("run", "model")


cte("ens", "SELECT grp, clip_id, c, sum(w * v) / 1.5 AS v FROM (SELECT grp, clip_id, c, v, 1.0 AS w FROM p UNION ALL SELECT grp, clip_id, c, v, 0.5 "
           "FROM ev) GROUP BY grp, clip_id, c", "p", "ev")
cte("ensgeo", "SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT grp, clip_id, c, exp(sum(w * ln(greatest(v, 1e-9))) / "
              "1.5) AS x FROM (SELECT grp, clip_id, c, v, 1.0 AS w FROM p UNION ALL SELECT grp, clip_id, c, v, 0.5 FROM ev) GROUP BY grp, clip_id, c)",
    "p", "ev")


@query("ensemble_arithmetic", pv_sql("ens"))
def _(spark, d):
    return long(P.ensemble(models(spark, d), {"a": 1.0, "b": 0.5}))


@query("ensemble_geometric", pv_sql("ensgeo"))
def _(spark, d):
    return long(P.ensemble(models(spark, d), {"a": 1.0, "b": 0.5}, "geo"))


sharpen_cte("sharp", "p", 1.4)
pool_cte("pooled", "p", "ev", 0.3)
cte("gated", "SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT p.grp, p.clip_id, p.c, exp((1 - g) * ln(greatest(p.v, "
             "1e-9)) + g * ln(greatest(ev.v, 1e-9))) AS x FROM (SELECT *, 0.5 * (1 - max(v) OVER (PARTITION BY clip_id)) AS g FROM p) p JOIN ev USING "
             "(clip_id, c))", "p", "ev")


@query("sharpen", pv_sql("sharp"))
def _(spark, d):
    return long(P.sharpen(probs(spark, d), 1.4))


@query("pool_log_linear", pv_sql("pooled"))
def _(spark, d):
    return long(P.pool(probs(spark, d), evidence(spark, d), 0.3))


@query("pool_gated", pv_sql("gated"))
def _(spark, d):
    return long(P.pool(probs(spark, d), evidence(spark, d), 0.5, gated=True))


cte("prior", "SELECT c, avg(v) AS m FROM p GROUP BY c", "p")
cte("gprior", "SELECT grp, c, avg(v) AS m FROM p GROUP BY grp, c", "p")


@query("prior_correct", with_ctes(f"SELECT clip_id, CAST(c AS INT) AS c, {r('v / pow(m + 1e-9, 0.7)')} AS v FROM p JOIN prior USING (c)", "p", "prior"))
def _(spark, d):
    return long(P.prior_correct(probs(spark, d), 0.7))


@query("prior_correct_per_group", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('v / pow(m + 1e-9, 0.7)')} AS v FROM p JOIN gprior USING (grp, c)", "p", "gprior"))
def _(spark, d):
    return long(P.prior_correct(probs(spark, d), 0.7, "grp"))


def f1_cte(name: str, src: str, by: str = "", n: int | None = N_CLASSES, y: str = "label", pred: str = "pred") -> None:
    """Macro-F1 per ``by`` of a (by, label, pred) relation."""
    key = by + ", " if by else ""
    cte(f"{name}_cls", f"SELECT {key}k, sum(sup) AS sup, sum(prd) AS prd, sum(tp) AS tp FROM (SELECT {key}{y} AS k, 1 AS sup, 0 AS prd, "
                       f"CASE WHEN {y} = {pred} THEN 1 ELSE 0 END AS tp FROM {src} UNION ALL SELECT {key}{pred}, 0, 1, 0 FROM {src}) GROUP BY {key}k", src)
    total = f"sum(2.0 * tp / (sup + prd)) / {n}" if n else "avg(2.0 * tp / (sup + prd))"
    cte(name, f"SELECT {key}{total} AS f1 FROM {name}_cls" + (f" GROUP BY {by}" if by else ""), f"{name}_cls")


cte("taus", "SELECT i * 0.05::DOUBLE AS tau FROM range(41) AS t(i)")
cte("taupred", "SELECT tau, label, arg_max(c, struct_pack(v := x, n := -c)) AS pred FROM (SELECT tau, p.clip_id, p.c, v / pow(m + 1e-9, tau) AS x FROM p "
               "JOIN prior USING (c), taus) q JOIN emb USING (clip_id) GROUP BY tau, clip_id, label", "p", "prior", "taus", "emb")
f1_cte("tauf1", "taupred", "tau")


def labelled(spark, d):
    return probs(spark, d).join(labels_of(spark, d), "clip_id")


@query("tau_scores", with_ctes(f"SELECT {r('tau')} AS tau, {r('f1')} AS f1 FROM tauf1", "tauf1"))
def _(spark, d):
    return rounded(P.tau_scores(labelled(spark, d), N_CLASSES))


@query("tune_tau", with_ctes(f"SELECT {r('tau')} AS tau, {r('f1')} AS f1 FROM tauf1 ORDER BY round(f1, 12) DESC, tau LIMIT 1", "tauf1"))
def _(spark, d):
    return rounded(P.tune_tau(labelled(spark, d), N_CLASSES))


@query("tune_class_weights")
def _(spark, d):
    best, logw = P.tune_weights(labelled(spark, d), N_CLASSES, sweeps=1, grid=[-0.4, -0.2, 0.0, 0.2, 0.4])
    return spark.createDataFrame([(c, float(w), float(best)) for c, w in enumerate(logw)], "class int, logw double, f1 double")


# three rounds of balancing towards 30 % of class 0
cte("sk0", "SELECT grp, clip_id, c, v + 1e-9 AS v FROM p", "p")
for _i in range(1, 4):
    cte(f"skr{_i}", f"SELECT grp, clip_id, c, v / sum(v) OVER (PARTITION BY clip_id) AS v FROM sk{_i - 1}", f"sk{_i - 1}")
    cte(f"sk{_i}", f"SELECT grp, clip_id, c, v * (CASE WHEN c = 0 THEN 0.3 ELSE 0.7 / {N_CLASSES - 1} END) * (count(*) OVER g) / "
                   f"((sum(v) OVER g) + 1e-9) AS v FROM skr{_i} WINDOW g AS (PARTITION BY grp, c)", f"skr{_i}")
cte("sinkhorn", "SELECT grp, clip_id, c, v / sum(v) OVER (PARTITION BY clip_id) AS v FROM sk3", "sk3")


@query("sinkhorn_balance", pv_sql("sinkhorn"))
def _(spark, d):
    return long(C.sinkhorn(probs(spark, d), "grp", 0.3, iters=3))


@query("fit_rate_map", with_ctes(
    f"SELECT {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept, {r('corr(x, y)')} AS r, {r('min(x)')} AS lo, {r('max(x)')} AS hi "
    f"FROM (SELECT grp, avg(CAST(pred = 0 AS INT)) AS x, avg(CAST(label = 0 AS INT)) AS y FROM pred GROUP BY grp)", "pred"))
def _(spark, d):
    rates = C.null_rates(predictions(spark, d), "grp", {"x": "pred", "y": "label"})
    return rounded(C.rate_map(rates, "x", "y"))


@query("null_rate_shift_search")
def _(spark, d):
    rates = C.null_rates(predictions(spark, d), "grp", {"q": "pred"})
    return rounded(C.shift_search(probs(spark, d), rates, "grp", 0.2, [-0.1, -0.05, 0.0, 0.05, 0.1], iters=5))


# count band of 8..12 per class and group, three rounds
cte("band0", f"SELECT grp, c.c, 0.0::DOUBLE AS b FROM (SELECT DISTINCT grp FROM emb), range({N_CLASSES}) AS c(c)", "emb")


def band_round(prefix: str, i: int, lo, hi, step: float, base: str) -> None:
    cte(f"{prefix}p{i}", f"SELECT clip_id, grp, arg_max(c, struct_pack(v := x, n := -c)) AS k FROM (SELECT p.clip_id, p.grp, p.c, "
                         f"ln(greatest(v, 1e-9)) + b AS x FROM {base} p JOIN {prefix}{i - 1} USING (grp, c)) GROUP BY clip_id, grp", base, f"{prefix}{i - 1}")
    cte(f"{prefix}{i}", f"SELECT b.grp, b.c, CASE WHEN b.c = 0 THEN b ELSE b + {step} * (CAST(coalesce(n, 0) < {lo} AS INT) - CAST(coalesce(n, 0) > {hi} "
                        f"AS INT)) END AS b FROM {prefix}{i - 1} b LEFT JOIN (SELECT grp, k, count(*) AS n FROM {prefix}p{i} GROUP BY grp, k) n ON "
                        f"n.grp = b.grp AND n.k = b.c", f"{prefix}{i - 1}", f"{prefix}p{i}")


for _i in range(1, 4):
    band_round("band", _i, 8, 12, 0.1, "p")
cte("bandpred", "SELECT clip_id, arg_max(c, struct_pack(v := x, n := -c)) AS pred FROM (SELECT clip_id, c, ln(greatest(v, 1e-9)) + b AS x FROM p JOIN "
                "band3 USING (grp, c)) GROUP BY clip_id", "p", "band3")


def logs(spark, d):
    return probs(spark, d).withColumn("l", E(A.log_each("p")))


@query("count_band", with_ctes("SELECT clip_id, CAST(pred AS INT) AS pred FROM bandpred", "bandpred"))
def _(spark, d):
    return C.count_band(logs(spark, d), "grp", 8, 12, iters=3).select("clip_id", "pred")


@query("count_band_settled")
def _(spark, d):
    return C.count_band(logs(spark, d), "grp", 6, 16, step=0.25, iters=24).groupBy("grp", "pred").count()


@query("soft_band", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('x / sum(x) OVER (PARTITION BY clip_id)')} AS v FROM (SELECT clip_id, c, v * exp(0.5 * b) AS x FROM p JOIN "
    f"band3 USING (grp, c))", "p", "band3"))
def _(spark, d):
    return long(C.apply_band(probs(spark, d), "grp", 8, 12, 0.5, iters=3))


# two rounds on the pair (1, 2), share of the second in [0.45, 0.55]
cte("pair0", "SELECT DISTINCT grp, 0.0::DOUBLE AS d FROM emb", "emb")
for _i in range(1, 3):
    cte(f"pairp{_i}", f"SELECT clip_id, grp, arg_max(c, struct_pack(v := x, n := -c)) AS k FROM (SELECT p.clip_id, p.grp, p.c, ln(greatest(v, 1e-9)) + CASE "
                      f"p.c WHEN 1 THEN -d WHEN 2 THEN d ELSE 0 END AS x FROM p JOIN pair{_i - 1} USING (grp)) GROUP BY clip_id, grp", "p", f"pair{_i - 1}")
    cte(f"pair{_i}", f"SELECT grp, CASE WHEN na + nc = 0 THEN d WHEN nc / (na + nc) < 0.45 THEN d + 0.05 WHEN nc / (na + nc) > 0.55 THEN d - 0.05 ELSE d END "
                     f"AS d FROM pair{_i - 1} JOIN (SELECT grp, count(*) FILTER (k = 1)::DOUBLE AS na, count(*) FILTER (k = 2)::DOUBLE AS nc FROM pairp{_i} "
                     f"GROUP BY grp) USING (grp)", f"pair{_i - 1}", f"pairp{_i}")


@query("pair_share_band", with_ctes(f"SELECT grp, {r('-d')} AS b1, {r('d')} AS b2 FROM pair2", "pair2"))
def _(spark, d):
    bias = C.pair_bias(logs(spark, d), "grp", [(1, 2)], 0.45, 0.55, iters=2)
    return rounded(bias.select("grp", E("b[1]").alias("b1"), E("b[2]").alias("b2")))


@query("composed_bands")
def _(spark, d):
    out = C.apply_band(probs(spark, d), "grp", 8, 12, 0.5, iters=4, pairs=[(1, 2), (3, 4)], share=(0.4, 0.6), beta_pair=0.5, pair_iters=4)
    return long(out)


cte("gate", "SELECT clip_id, label, max(CASE WHEN c = 0 THEN v END) AS s, arg_max(c, struct_pack(v := CASE WHEN c = 0 THEN -1 ELSE v END, n := -c)) AS act "
            "FROM p JOIN emb USING (clip_id) GROUP BY clip_id, label", "p", "emb")


@query("null_gate", with_ctes("SELECT clip_id, CAST(CASE WHEN s >= 0.2 THEN 0 ELSE act END AS INT) AS pred FROM gate", "gate"))
def _(spark, d):
    return P.null_gate(probs(spark, d).withColumn("s", E("p[0]")), "s", 0.2).select("clip_id", "pred")


cte("ths_", "SELECT 0.3 AS q, quantile_cont(s, 0.3) AS threshold FROM gate UNION ALL SELECT 0.4, quantile_cont(s, 0.4) FROM gate UNION ALL SELECT 0.5, "
            "quantile_cont(s, 0.5) FROM gate UNION ALL SELECT 0.6, quantile_cont(s, 0.6) FROM gate", "gate")
cte("scan", "SELECT q, threshold, label, CASE WHEN s >= threshold THEN 0 ELSE act END AS pred FROM gate, ths_", "gate", "ths_")
f1_cte("scanf1", "scan", "q")


@query("threshold_scan", with_ctes(f"SELECT {r('q')} AS q, {r('f1')} AS f1 FROM scanf1", "scanf1"))
def _(spark, d):
    rows = labelled(spark, d).withColumn("s", E("p[0]"))
    return rounded(M.threshold_scan(rows, "s", "p", "label", N_CLASSES, [0.3, 0.4, 0.5, 0.6]).select("q", "f1"))


cte("fam", "SELECT p.clip_id, p.c, p.v, ev.v AS e, p.c IN (1, 2, 3) AS m FROM p JOIN ev USING (clip_id, c)", "p", "ev")
cte("fam2", "SELECT *, exp(0.7 * ln(v / greatest(mass, 1e-12) + 1e-9) + 0.3 * ln(e / esum + 1e-9)) AS x FROM (SELECT *, sum(v) OVER (PARTITION BY clip_id) AS "
            "mass, sum(e) OVER (PARTITION BY clip_id) AS esum FROM fam WHERE m)", "fam")


@query("resplit_family", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('mass * x / sum(x) OVER (PARTITION BY clip_id)')} AS v FROM fam2 UNION ALL SELECT clip_id, CAST(c AS INT), "
    f"{r('v')} FROM fam WHERE NOT m", "fam", "fam2"))
def _(spark, d):
    within = evidence(spark, d).select("clip_id", E(A.divide_by_sum("slice(p, 2, 3)")).alias("within"))
    return long(P.resplit_family(probs(spark, d).join(within, "clip_id"), [1, 2, 3], "within", 0.3))


cte("logblend", "SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT p.grp, clip_id, c, exp(0.6 * ln(p.v + 1e-9) + 0.4 * ln(ev.v "
                "+ 1e-9)) AS x FROM p JOIN ev USING (clip_id, c))", "p", "ev")


@query("blend_log", pv_sql("logblend"))
def _(spark, d):
    return long(P.blend(probs(spark, d), evidence(spark, d), 0.4))


@query("blend_linear", with_ctes(f"SELECT clip_id, CAST(c AS INT) AS c, {r('0.6 * p.v + 0.4 * ev.v')} AS v FROM p JOIN ev USING (clip_id, c)", "p", "ev"))
def _(spark, d):
    return long(P.blend(probs(spark, d), evidence(spark, d), 0.4, "linear"))


@query("average_all_sensors", pv_sql("arith"))
def _(spark, d):
    two = runs(spark, d).withColumn("sensor", E("IF(run = 'a', 0, 1)"))
    return long(P.average_sensors(two, 2))


@query("average_one_sensor")
def _(spark, d):
    return long(P.average_sensors(runs(spark, d).withColumn("sensor", E("IF(run = 'a', 0, 1)")), 1))


cte("links", "SELECT clip_id AS src, clip_id + 5 AS dst FROM emb WHERE clip_id % 3 = 0 AND clip_id + 5 IN (SELECT clip_id FROM emb)", "emb")
cte("sym", "SELECT src, dst FROM links UNION SELECT dst, src FROM links", "links")
_prev = "p"
for _i in range(1, 4):
    cte(f"sl{_i}", f"SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT b.grp, b.clip_id, b.c, CASE WHEN a.v IS NULL THEN b.v ELSE "
                   f"0.5 * b.v + 0.5 * a.v END AS x FROM p b LEFT JOIN (SELECT src, q.c, avg(q.v) AS v FROM sym JOIN {_prev} q ON q.clip_id = dst GROUP BY src, "
                   f"q.c) a ON a.src = b.clip_id AND a.c = b.c)", "p", "sym", _prev)
    _prev = f"sl{_i}"


@query("smooth_links", pv_sql(_prev))
def _(spark, d):
    e = emb(spark, d).select("clip_id")
    links = e.where("clip_id % 3 = 0").select(F.col("clip_id").alias("src"), (F.col("clip_id") + 5).alias("dst")) \
        .join(e.withColumnRenamed("clip_id", "dst"), "dst", "left_semi")
    return long(P.smooth_links(probs(spark, d), links, 0.5, iters=3))


@query("entropy_and_confidence", with_ctes(
    f"SELECT clip_id, {r('max(v)')} AS confidence, {r('-sum(v * ln(v + 1e-12))')} AS entropy FROM p GROUP BY clip_id", "p"))
def _(spark, d):
    return rounded(probs(spark, d).select("clip_id", E("array_max(p)").alias("confidence"), E(A.entropy("p")).alias("entropy")))


@query("argmax_decision", with_ctes("SELECT clip_id, pred FROM pred", "pred"))
def _(spark, d):
    return predictions(spark, d).select("clip_id", "pred")


@query("parameter_grid", with_ctes(
    f"SELECT g.config, clip_id, {r('max(v) * g.lam')} AS v FROM p, (VALUES ('low', 0.5::DOUBLE), ('high', 2.0::DOUBLE)) AS g(config, lam) GROUP BY g.config, "
    f"g.lam, clip_id", "p"))
def _(spark, d):
    rows = P.with_grid(probs(spark, d), [{"config": "low", "lam": 0.5}, {"config": "high", "lam": 2.0}])
    return rounded(rows.select("config", "clip_id", E("array_max(p) * lam").alias("v")))


@query("prediction_drift", with_ctes(
    f"SELECT CAST(coalesce(a.k, b.k) AS INT) AS pred, {r('coalesce(a.s, 0)')} AS share_a, {r('coalesce(b.s, 0)')} AS share_b, "
    f"{r('coalesce(b.s, 0) - coalesce(a.s, 0)')} AS delta FROM (SELECT pred AS k, count(*) / (SELECT count(*) FROM pred) AS s FROM pred GROUP BY pred) a FULL JOIN (SELECT base_pred AS "
    f"k, count(*) / (SELECT count(*) FROM pred) AS s FROM pred GROUP BY base_pred) b ON a.k = b.k", "pred"))
def _(spark, d):
    x = predictions(spark, d)
    return rounded(P.drift(x.select("pred"), x.select(F.col("base_pred").alias("pred"))))


@query("describe_probabilities", with_ctes(
    f"SELECT grp, {r('avg(m)')} AS mean_top, {r('median(m)')} AS median_top, {r('avg(e)')} AS mean_entropy FROM (SELECT grp, clip_id, max(v) AS m, "
    f"-sum(v * ln(v + 1e-12)) AS e FROM p GROUP BY grp, clip_id) GROUP BY grp", "p"))
def _(spark, d):
    return rounded(P.describe(probs(spark, d), "grp"))


@query("sample_per_group", with_ctes(
    "SELECT grp, clip_id FROM (SELECT grp, clip_id, row_number() OVER (PARTITION BY grp ORDER BY (clip_id * 7919) % 1009, clip_id) AS n FROM emb) WHERE n <= 20", "emb"))
def _(spark, d):
    return sample_per_group(emb(spark, d).select("grp", "clip_id"), "grp", 20, 0, draw="(clip_id * 7919) % 1009")
