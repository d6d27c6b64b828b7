"""Folds, regressions and classifiers."""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import ml
from clipgraph.operators import metrics as M
from clipgraph.operators import subspace as S
from clipgraph.operators.filters import in_family
from clipgraph.operators.probs import blend
from clipgraph.registry.core import (N_CLASSES, E, cte, edges, emb, events, evidence, kept, labels_of, long, probs, query, r, rounded, table,
                                     with_ctes)


@query("group_folds_balanced", """WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS i FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)),
deal AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS BIGINT) AS fold, CAST(0 AS BIGINT) AS n UNION ALL
SELECT d.i + 1, list_transform(range(1, 6), lambda k: d.load[k] + CASE WHEN k = list_position(d.load, list_min(d.load)) THEN g.n ELSE 0 END), list_position(d.load, list_min(d.load)) - 1, g.n FROM deal d JOIN g ON g.i = d.i + 1)
SELECT CAST(fold AS INT) AS fold, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS groups FROM deal WHERE fold IS NOT NULL GROUP BY fold""")
def _(spark, d):
    folds = ml.group_kfold(events(spark, d), "rec", 5, seed=1)
    return events(spark, d).select("rec").join(folds, "rec").groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("rec").alias("groups"))


@query("round_robin_folds", "SELECT user_id AS rec, CAST((row_number() OVER (ORDER BY user_id * 7919 % 1009, user_id) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    return ml.hash_folds(events(spark, d), "rec", 5, draw="rec * 7919 % 1009")


@query("leave_one_group_out_folds", "SELECT user_id AS rec, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INT) AS fold FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    return ml.leave_one_group_out(events(spark, d), "rec")


def xy(spark, d):
    """Two covariates and one target per event, seven groups."""
    return events(spark, d).select("event_id", "grp", E("array(x, y)").alias("x"), E("array(z)").alias("y"))


def xy_folds(spark, d):
    return events(spark, d).select("grp").distinct().withColumn("fold", E("CAST(grp AS INT)"))


# two covariates: the normal equations are solved by Cramer's rule
cte("ridge_sums", "SELECT a.grp AS fold, count(*)::DOUBLE AS n, avg(b.x) AS mx, avg(b.y) AS my, avg(b.z) AS mz, stddev_pop(b.x) + 1e-6 AS sx, stddev_pop(b.y) + 1e-6 AS sy, covar_pop(b.x, b.z) AS xz, "
                  "covar_pop(b.y, b.z) AS yz, covar_pop(b.x, b.y) AS xy, var_pop(b.x) AS vx, var_pop(b.y) AS vy FROM (SELECT DISTINCT grp FROM ev_rows) a JOIN ev_rows b ON b.grp <> a.grp GROUP BY a.grp", "ev_rows")
cte("ridge_fit", "SELECT *, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) / sx AS w1, (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) / sy AS w2 FROM (SELECT *, n * vx / (sx * sx) + 5 AS a11, n * vy / (sy * sy) + 5 AS "
                 "a22, n * xy / (sx * sy) AS a12, n * xz / sx AS c1, n * yz / sy AS c2 FROM ridge_sums)", "ridge_sums")


@query("ridge_out_of_fold", with_ctes(
    f"SELECT e.event_id, {r('mz + w1 * (e.x - mx) + w2 * (e.y - my)', 5)} AS yhat FROM ev_rows e JOIN ridge_fit f ON f.fold = e.grp", "ev_rows", "ridge_fit"))
def _(spark, d):
    out = ml.ridge_oof(xy(spark, d), "x", "y", 5.0, xy_folds(spark, d), "grp")
    return out.select("event_id", F.round(E("yhat[0]"), 5).alias("yhat"))


@query("ridge_penalty_choice")
def _(spark, d):
    out = ml.ridge_cv(xy(spark, d), "x", "y", [0.1, 10.0, 1000.0], xy_folds(spark, d), "grp")
    return out.groupBy("lam").agg(F.count(F.lit(1)).alias("n"))


cte("resid", "SELECT grp, avg(z) AS mz, regr_slope(z, x) AS b, avg(x) AS mx FROM ev_rows GROUP BY grp", "ev_rows")


@query("residualize", with_ctes(f"SELECT e.event_id, {r('e.z - b * (e.x - mx)', 5)} AS z FROM ev_rows e JOIN resid USING (grp)", "ev_rows", "resid"))
def _(spark, d):
    rows = events(spark, d).select("event_id", "grp", E("array(x)").alias("x"), E("array(z)").alias("y"))
    return ml.residualize(rows, "y", "x", 0.0, "grp").select("event_id", F.round(E("y[0]"), 5).alias("z"))


@query("transfer_readout", with_ctes(
    f"SELECT CAST(b.grp AS BIGINT) AS grp, {r('corr(m.mz + m.b * (b.x - m.mx), b.z)')} AS pearson FROM ev_rows b, (SELECT avg(z) AS mz, avg(x) AS mx, covar_pop(x, z) / pow(stddev_pop(x) + 1e-6, 2) * (count(*) * pow("
    f"stddev_pop(x) + 1e-6, 2) / (count(*) * var_pop(x) + pow(stddev_pop(x) + 1e-6, 2))) AS b FROM ev_rows WHERE grp < 3) m WHERE b.grp >= 3 GROUP BY b.grp", "ev_rows"))
def _(spark, d):
    rows = events(spark, d).select("grp", E("array(x)").alias("x"), E("array(z)").alias("y"))
    out = ml.transfer_readout(rows.where("grp < 3"), rows.where("grp >= 3"), "x", "y")
    return rounded(M.pearson(out.select("grp", E("yhat[0]").alias("a"), E("y[0]").alias("b")), "a", "b", "grp"))


def group_folds(spark, d):
    return emb(spark, d).select("grp").distinct().withColumn("fold", E("CAST(grp AS INT)"))


@query("classifier_out_of_fold")
def _(spark, d):
    oof, _t = ml.classifier_oof(emb(spark, d), "f", "label", group_folds(spark, d), "grp", N_CLASSES)
    return long(oof)


@query("classifier_test_mean")
def _(spark, d):
    rows = emb(spark, d)
    test = table(spark, d, "embeddings").selectExpr("vec_id AS test_id", f"{A.to_double('embedding')} AS f")
    _o, out = ml.classifier_oof(rows, "f", "label", group_folds(spark, d), "grp", N_CLASSES, LogisticRegression(maxIter=10, regParam=0.1), test=test)
    return long(out, keep=("test_id",))


@query("second_stage_classifier")
def _(spark, d):
    rows = emb(spark, d).withColumn("sensor", E("CAST(clip_id % 4 AS INT)"))
    x = ml.stage2_features(rows, edges(spark, d), probs(spark, d), 4).select("clip_id", "grp", "label", "x")
    oof, _t = ml.classifier_oof(x, "x", "label", group_folds(spark, d), "grp", N_CLASSES, LogisticRegression(maxIter=10, regParam=0.1))
    return long(blend(probs(spark, d), oof, 0.3))


@query("family_classifiers")
def _(spark, d):
    oof = ml.family_oof(emb(spark, d), "f", "label", {"low": [1, 2], "high": [7, 8, 9]}, group_folds(spark, d), "grp", LogisticRegression(maxIter=10, regParam=0.1))
    return long(oof, keep=("family", "clip_id"))


@query("pair_link_scores")
def _(spark, d):
    from clipgraph.operators import joins as J
    from clipgraph.registry.scoring import candidates, dists

    ranked = J.pair_ranks(candidates(spark, d), emb(spark, d), ["grp"], dists()["cos"], ["f"])
    expr = {"d_cos": f"1 - {A.cosine('a_f', 'b_f')}", "d_euc": A.let(A.sub("a_f", "b_f"), A.norm), "linked": "CAST(a_label = b_label AS INT)",
            "log_row": "ln(1 + row_rank)", "log_col": "ln(1 + col_rank)", "half": "CAST(src % 2 AS INT)"}
    rows = J.pair_values(ranked, emb(spark, d), expr, ["f", "label"])
    out = ml.link_scorer(rows, "linked", "half", ["d_cos", "d_euc", "log_row", "log_col"])
    return rounded(out.select("src", "dst", "link_p"), 4)


@query("self_training")
def _(spark, d):
    from clipgraph.operators import graph, grouped

    blended = grouped.self_train(emb(spark, d), probs(spark, d), "f", 0.5, 0.3, N_CLASSES, min_rows=20)
    return long(graph.multistage(blended, emb(spark, d), [4.0, 4.0], k=30, alpha=0.75, iters=5), digits=4)


@query("soft_label_classifier")
def _(spark, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = emb(spark, d).join(probs(spark, d).select("clip_id", "p"), "clip_id")
    model = ml.fit_soft_labels(rows, "f", "p", 5)
    scored = model.transform(rows.withColumn("features", array_to_vector("f")).drop("p"))
    return long(scored.select("clip_id", vector_to_array("probability").alias("p")), digits=4)


@query("pca_classifier_input")
def _(spark, d):
    return long(ml.pca_input(emb(spark, d), "f", 8), "z", digits=4)


@query("factor_analysis_scores")
def _(spark, d):
    from clipgraph.operators import factor

    rows = emb(spark, d)
    return long(factor.scores(rows, "f", factor.fit(rows, "f", [32, 16, 16], 3, [2, 1, 1])), "z", digits=4)


@query("impute_sensor_blocks", with_ctes(
    f"SELECT e.clip_id, CAST(b.b AS INT) AS block, CAST(u.pos - 1 AS INT) AS c, {r('CASE WHEN e.clip_id % 4 = b.b THEN e.f[u.pos] ELSE coalesce(m.v, 0) END')} AS v FROM emb e, range(4) AS b(b), range(1, 65) AS u(pos) LEFT JOIN "
    f"(SELECT src, dst % 4 AS s, pos, avg(v) AS v FROM (SELECT src, dst FROM knn UNION ALL SELECT clip_id, clip_id FROM emb) k JOIN coord ON coord.clip_id = k.dst GROUP BY ALL) m ON m.src = e.clip_id AND m.s = b.b AND m.pos = "
    f"u.pos", "emb", "knn", "coord"))
def _(spark, d):
    rows = emb(spark, d).withColumn("sensor", E("CAST(clip_id % 4 AS INT)"))
    return long(ml.impute_blocks(rows, edges(spark, d), 4), "f", ("clip_id", "block"))


@query("complete_sensor_blocks")
def _(spark, d):
    from clipgraph.operators.completion import complete

    rows = emb(spark, d).select("clip_id", "grp", E("CAST(clip_id % 4 AS INT)").alias("sensor"), E("slice(f, 1 + 16 * CAST(clip_id % 4 AS INT), 16)").alias("f"))
    basis = S.pca_by(emb(spark, d), None, 8)
    w = basis.agg(F.sort_array(F.collect_list(F.struct("j", "b"))).alias("_b"))  # eight directions of all 64 dimensions, cut into the blocks of four sensors
    w = w.select(E("explode(sequence(0, 3))").alias("sensor"), "_b").select("sensor", E("transform(sequence(16 * sensor, 16 * sensor + 15), i -> transform(_b, x -> x.b[i]))").alias("w"))
    return long(complete(rows, w, edges(spark, d), 0.1, 0.1), "z", digits=4)
