"""Metric, join and diagnostic queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import diagnostics as D
from clipgraph.operators import graph as G
from clipgraph.operators import joins as J
from clipgraph.operators import knn as K
from clipgraph.operators import metrics as M
from clipgraph.operators.ordered import quantiles, shifted
from clipgraph.plans import refine as plans
from clipgraph.registry.core import (KNN, N_CLASSES, E, cte, edges, emb, events, evidence, kept, labels_of, long, predictions, probs, query,
                                     r, rounded, samples, table, with_ctes)
from clipgraph.registry.decisions import f1_cte
from clipgraph.registry.graphs import by_sensor

I = "CAST({} AS INT)"  # noqa: E741


@query("confusion_by_group", with_ctes("SELECT grp, label, pred, count(*) AS n FROM pred GROUP BY ALL", "pred"))
def _(spark, d):
    return M.confusion(predictions(spark, d), "label", "pred", "grp")


f1_cte("pf", "pred")
f1_cte("pg", "pred", "grp")
f1_cte("ppresent", "pred", "grp", None)


@query("precision_recall_f1", with_ctes(
    f"SELECT {I.format('k')} AS class, CAST(sup AS BIGINT) AS support, CAST(prd AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp, "
    f"{r('CASE WHEN prd > 0 THEN tp / prd ELSE 0 END')} AS precision, {r('CASE WHEN sup > 0 THEN tp / sup ELSE 0 END')} AS recall, "
    f"{r('2 * tp / (sup + prd)')} AS f1 FROM pf_cls", "pf_cls"))
def _(spark, d):
    return rounded(M.prf(M.confusion(predictions(spark, d), "label", "pred"), None, "label", "pred"))


@query("macro_f1_by_group", with_ctes(f"SELECT grp, {r('f1')} AS f1 FROM pg", "pg"))
def _(spark, d):
    return rounded(M.score(predictions(spark, d), "label", "pred", N_CLASSES, "grp"))


@query("macro_f1_without_null", with_ctes(f"SELECT {r('sum(2.0 * tp / (sup + prd)) / 9')} AS f1 FROM pf_cls WHERE k <> 0", "pf_cls"))
def _(spark, d):
    return rounded(M.score(predictions(spark, d), "label", "pred", N_CLASSES, None, skip_null=True))


@query("macro_f1_present_classes", with_ctes(f"SELECT grp, {r('f1')} AS f1 FROM ppresent", "ppresent"))
def _(spark, d):
    return rounded(M.score(predictions(spark, d), "label", "pred", None, "grp"))


@query("crosstab_rec_label", "SELECT user_id AS rec, " + ", ".join(
    f"count(*) FILTER (event_type = '{n}') AS \"{c}\"" for n, c in (("view", 0), ("click", 1), ("purchase", 2), ("signup", 3), ("error", 4)))
    + " FROM events GROUP BY user_id")
def _(spark, d):
    return M.crosstab(events(spark, d), "rec", "label", [0, 1, 2, 3, 4])


@query("leave_one_out_percentile", with_ctes(
    f"SELECT o.rec, q, {r('CASE q WHEN 0.05 THEN quantile_cont(n, 0.05) ELSE quantile_cont(n, 0.95) END')} AS n FROM (SELECT DISTINCT rec FROM ev_rows) o JOIN "
    f"(SELECT rec, label, count(*)::DOUBLE AS n FROM ev_rows WHERE label <> 0 GROUP BY rec, label) c ON c.rec <> o.rec, (VALUES (0.05::DOUBLE), "
    f"(0.95::DOUBLE)) AS t(q) GROUP BY o.rec, q", "ev_rows"))
def _(spark, d):
    counts = events(spark, d).where("label <> 0").groupBy("rec", "label").count().withColumnRenamed("count", "n")
    return rounded(M.loo_percentile(counts, "rec", "n", [0.05, 0.95]))


@query("weighted_average", "SELECT l_returnflag, (round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) + CAST(0 AS DOUBLE)) AS value FROM lineitem "
                           "GROUP BY l_returnflag")
def _(spark, d):
    return rounded(M.wavg(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag"), 4)


cte("segs", "SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY idx) AS seg FROM (SELECT *, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS new "
            "FROM samples WINDOW w AS (PARTITION BY rec ORDER BY idx))", "samples")


def segmented(spark, d):
    from clipgraph.operators.windows import segments

    return kept(spark, d, "segments", lambda: segments(samples(spark, d), "rec", ["us", "event_id"]))


@query("mode_and_purity", with_ctes(
    f"SELECT rec, {I.format('arg_max(sensor, struct_pack(n := n, s := -sensor))')} AS mode, {r('max(n) / sum(n)')} AS purity, CAST(sum(n) AS BIGINT) AS n FROM "
    f"(SELECT rec, sensor, count(*) AS n FROM samples GROUP BY rec, sensor) GROUP BY rec", "samples"))
def _(spark, d):
    return rounded(M.mode_and_purity(events(spark, d), "rec", "sensor").withColumn("mode", E("CAST(mode AS INT)")))


# segments of the clip table: the group and label; three label columns
cte("segmode", "SELECT grp, label, count(*) AS n, " + ", ".join(
    f"(SELECT k FROM (SELECT {c} AS k, count(*) AS n FROM pred q WHERE q.grp = p.grp AND q.label = p.label GROUP BY {c}) ORDER BY n DESC, k LIMIT 1) AS mode_{c}"
    for c in ("pred", "base_pred")) + " FROM pred p GROUP BY grp, label", "pred")


def segment_modes(spark, d):
    return M.segment_accuracy(predictions(spark, d).withColumn("y", F.col("label")), ["grp", "label"], "y", ["pred", "base_pred"], 5)


@query("segment_accuracy", with_ctes("SELECT grp, label, label AS y, n, mode_pred, mode_base_pred FROM segmode WHERE n >= 5", "segmode"))
def _(spark, d):
    return segment_modes(spark, d)


@query("segment_error_attribution", with_ctes(
    "SELECT grp, count(*) AS wrong, count(*) FILTER (mode_base_pred = label AND label % 2 <> 0) AS only_a, count(*) FILTER (mode_base_pred <> label AND label % 2 "
    "= 0) AS only_b, count(*) FILTER (mode_base_pred = label AND label % 2 = 0) AS both, count(*) FILTER (mode_base_pred <> label AND label % 2 <> 0) AS neither "
    "FROM segmode WHERE n >= 5 AND mode_pred <> label GROUP BY grp", "segmode"))
def _(spark, d):
    rows = segment_modes(spark, d).withColumn("other", E("y - y % 2"))
    return M.error_attribution(rows, "y", "mode_pred", "mode_base_pred", "other", "grp")


@query("label_flow", with_ctes('SELECT base_pred AS "from", pred AS "to", count(*) AS n FROM pred WHERE pred <> base_pred GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10',
                               "pred"))
def _(spark, d):
    return M.flow_table(predictions(spark, d), "base_pred", "pred", 10)


@query("share_report", with_ctes(
    f"SELECT grp, {r('max(CASE WHEN c = 0 THEN s END)')} AS null_rate, {I.format('count(*) FILTER (s >= 0.01)')} AS n_used, {r('min(CASE WHEN c > 0 THEN s END)')} "
    f"AS min_share FROM (SELECT g.grp, c.c, avg(CAST(pred = c.c AS INT)) AS s FROM pred g, range(10) AS c(c) GROUP BY g.grp, c.c) GROUP BY grp", "pred"))
def _(spark, d):
    return rounded(M.share_report(predictions(spark, d), "pred", N_CLASSES, "grp"))


_nmi = ("SELECT {key} {val} AS nmi FROM (SELECT {key} sum(nij / n * ln(nij * n / (ni * nj))) AS mi, -sum(nij / n * ln(ni / n)) AS ha, -sum(nij / n * ln(nj / n)) AS hb "
        "FROM (SELECT *, sum(nij) OVER ({p} {a}) AS ni, sum(nij) OVER ({p} {b}) AS nj, sum(nij) OVER ({q}) AS n FROM (SELECT {key} {a}, {b}, count(*)::DOUBLE AS nij "
        "FROM {t} GROUP BY ALL)) {g})")


@query("normalized_mutual_information", _nmi.format(key="", val=r("mi / ((ha + hb) / 2)"), p="PARTITION BY", q="", a="quality", b="toxic", t="labels", g=""))
def _(spark, d):
    return rounded(M.nmi(table(spark, d, "labels"), "quality", "toxic"))


@query("nmi_by_group", with_ctes(_nmi.format(key="grp,", val=r("mi / ((ha + hb) / 2)"), p="PARTITION BY grp,", q="PARTITION BY grp", a="label", b="pred", t="pred",
                                             g="GROUP BY grp"), "pred"))
def _(spark, d):
    return rounded(M.nmi(predictions(spark, d), "label", "pred", "grp"))


@query("pearson", f"SELECT source, {r('covar_pop(n_chars, quality) / nullif(stddev_pop(n_chars) * stddev_pop(quality), 0)')} AS pearson FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double")).join(table(spark, d, "labels"), "doc_id")
    return rounded(M.pearson(rows, "n_chars", "quality", "source"))


@query("spearman", with_ctes(
    f"SELECT grp, {r('corr(rx, ry)')} AS spearman FROM (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS rx, "
    f"rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry FROM ev_rows) GROUP BY grp", "ev_rows"))
def _(spark, d):
    return rounded(M.spearman(events(spark, d), "x", "y", "grp"))


cte("conf2", "SELECT label, pred, count(*)::DOUBLE AS n FROM pred GROUP BY ALL", "pred")
cte("rates", "SELECT label, pred, n / sum(n) OVER (PARTITION BY label) AS x FROM conf2", "conf2")
cte("confus", "SELECT a, b, sum(x) / 2 AS rate FROM (SELECT label AS a, pred AS b, x FROM rates UNION ALL SELECT pred, label, x FROM rates) WHERE a <> b GROUP BY a, b",
    "rates")


@query("class_pair_confusability", with_ctes(f"SELECT a, b, {r('rate')} AS rate FROM confus", "confus"))
def _(spark, d):
    return rounded(M.confusability(M.confusion(predictions(spark, d), "label", "pred"), "label", "pred"))


_auc = ("(sum(CASE WHEN y = 1 THEN rk * 1.0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))")


@query("auc", f"SELECT {r(_auc)} AS auc FROM (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk "
              f"FROM documents JOIN labels USING (doc_id))")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rounded(M.auc(rows, "n_chars", "quality"))


@query("auc_weighted_by_group", with_ctes(
    f"SELECT grp, {r('sum(pw * (below + 0.5 * qw)) / (sum(pw) * sum(qw))')} AS auc FROM (SELECT *, coalesce(sum(qw) OVER (PARTITION BY grp ORDER BY x ROWS BETWEEN "
    f"UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT grp, x, sum(CASE WHEN label = 0 THEN y ELSE 0 END) AS pw, sum(CASE WHEN label = 0 THEN 0 ELSE y "
    f"END) AS qw FROM ev_rows GROUP BY grp, x)) GROUP BY grp", "ev_rows"))
def _(spark, d):
    return rounded(M.auc(events(spark, d).withColumn("t", E("CAST(label = 0 AS INT)")), "x", "t", "grp", "y"))


@query("pooled_r2", with_ctes(
    f"SELECT {r('1 - sum(pow(x - y, 2)) / sum(pow(x - m, 2))')} AS r2 FROM (SELECT x, y, avg(x) OVER (PARTITION BY grp) AS m FROM ev_rows)", "ev_rows"))
def _(spark, d):
    return rounded(M.pooled_r2(events(spark, d), "x", "y", "grp"))


@query("class_mean_of_values", with_ctes(f"SELECT grp, {r('avg(m)')} AS x FROM (SELECT grp, label, avg(x) AS m FROM ev_rows WHERE label <> 0 GROUP BY ALL) GROUP BY grp",
                                         "ev_rows"))
def _(spark, d):
    return rounded(M.class_mean(events(spark, d), "x", "label", "grp"))


@query("rollup_scores", "SELECT l_returnflag, l_linestatus, (round(avg(l_extendedprice), 4) + CAST(0 AS DOUBLE)) AS mean, (round(stddev_pop(l_extendedprice), 4) + CAST(0 AS "
                        "DOUBLE)) AS std, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return rounded(M.rollup_scores(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


@query("cell_shares", "SELECT lang, source, (round(n / sum(n) OVER (PARTITION BY source), 6) + CAST(0 AS DOUBLE)) AS frac FROM (SELECT source, lang, count(*) AS n FROM "
                      "documents GROUP BY ALL) QUALIFY sum(n) OVER (PARTITION BY lang) / sum(n) OVER () > 0.002")
def _(spark, d):
    return rounded(M.cell_shares(table(spark, d, "documents").select("source", "lang"), "source", "lang"))


cte("bgrp", "SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM pred)", "pred")
cte("bdraw", "SELECT rep, b.grp, k FROM (SELECT rep, CAST('0x' || substr(md5('1:' || rep || ':' || g), 1, 8) AS BIGINT) % n AS g, count(*) AS k FROM bgrp, range(200) AS t(rep) "
             "GROUP BY ALL) JOIN bgrp b USING (g)", "bgrp")
cte("bconf", "SELECT config, grp, label, pred, count(*) AS n FROM (SELECT 'refined' AS config, grp, label, pred FROM pred UNION ALL SELECT 'base', grp, label, base_pred FROM pred) "
             "GROUP BY ALL", "pred")
for _name, _src, _key in (("bdrawn", "(SELECT config, rep, label, pred, sum(n * k) AS n FROM bconf JOIN bdraw USING (grp) GROUP BY ALL)", "config, rep"),
                          ("bown", "bconf", "config, grp"), ("bwhole", "bconf", "config")):
    cte(_name, f"SELECT {_key}, avg(2.0 * tp / (sup + prd)) AS f1 FROM (SELECT {_key}, c, sum(sup) AS sup, sum(prd) AS prd, sum(tp) AS tp FROM (SELECT {_key}, label AS c, n AS sup, 0 AS prd, "
               f"CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM {_src} UNION ALL SELECT {_key}, pred, 0, n, 0 FROM {_src}) GROUP BY {_key}, c) GROUP BY {_key}", "bconf", "bdraw")


@query("bootstrap_interval", with_ctes(f"SELECT {r('quantile_cont(f1, 0.025)')} AS lo, {r('quantile_cont(f1, 0.975)')} AS hi, {r('avg(f1)')} AS mean FROM bdrawn "
                                       "WHERE config = 'refined'", "bdrawn"))
def _(spark, d):
    return rounded(M.bootstrap_ci(M.confusion(predictions(spark, d), "label", "pred", "grp"), "grp", 200, 1, "label", "pred"))


@query("bootstrap_paired_difference", with_ctes(
    f"SELECT 'base' AS a, 'refined' AS b, {r('(SELECT max(f1) FILTER (config = $$refined$$) - max(f1) FILTER (config = $$base$$) FROM bwhole)')} AS diff, "
    f"{r('quantile_cont(y.f1 - x.f1, 0.025)')} AS lo, {r('quantile_cont(y.f1 - x.f1, 0.975)')} AS hi, "
    "(SELECT count(*) FROM bown u JOIN bown v USING (grp) WHERE u.config = 'base' AND v.config = 'refined' AND v.f1 - u.f1 > 1e-12) AS improved, "
    "(SELECT count(*) FROM bown WHERE config = 'base') AS groups FROM bdrawn x JOIN bdrawn y USING (rep) WHERE x.config = 'base' AND y.config = 'refined'",
    "bdrawn", "bown", "bwhole"))
def _(spark, d):
    p = predictions(spark, d)
    both = p.select("grp", "label", "pred", F.lit("refined").alias("config")).unionByName(p.select("grp", "label", F.col("base_pred").alias("pred"), F.lit("base").alias("config")))
    return rounded(M.bootstrap_paired(M.confusion(both, "label", "pred", ["config", "grp"]), "grp", 200, "config", [("base", "refined")], 1, "label", "pred"))


@query("bootstrap_pair_auc")
def _(spark, d):
    pairs = D.with_ends(edges(spark, d), labels_of(spark, d), ["label"]).selectExpr(
        "src % 5 * 100 + src % 100 AS ua", "dst % 5 * 100 + dst % 100 AS ub", "sim", "CAST(s_label = t_label AS INT) AS same")
    return rounded(M.bootstrap_auc(pairs, "ua", "ub", "sim", "same", 20, 3))


@query("wilcoxon", with_ctes(
    f"SELECT w_plus, w_minus, n_plus, n_minus, {r('(w_plus - (n_plus + n_minus) * (n_plus + n_minus + 1) / 4) / sqrt((n_plus + n_minus) * (n_plus + n_minus + 1) * (2 * (n_plus + n_minus) + 1) / 24)')} "
    f"AS z FROM (SELECT sum(CASE WHEN dd > 0 THEN rk ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN dd < 0 THEN rk ELSE 0 END)::DOUBLE AS w_minus, count(*) FILTER (dd > 0) AS n_plus, "
    f"count(*) FILTER (dd < 0) AS n_minus FROM (SELECT dd, rank() OVER (ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY abs(dd)) - 1) / 2.0 AS rk FROM (SELECT x - y AS dd "
    f"FROM ev_rows) WHERE dd <> 0))", "ev_rows"))
def _(spark, d):
    return rounded(M.wilcoxon(events(spark, d), "x", "y"))


cte("seedscore", "SELECT config, CAST(seed AS INT) AS seed, avg(CAST(ok AS INT)) AS f1 FROM (SELECT grp AS seed, 'current' AS config, pred = label AS ok FROM pred UNION ALL "
                 "SELECT grp, 'other', base_pred = label FROM pred) GROUP BY ALL", "pred")


@query("paired_differences", with_ctes(
    f"SELECT config, {r('avg(a.f1)')} AS mean, {r('avg(a.f1 - b.f1)')} AS diff, (bool_and(a.f1 - b.f1 > 0) OR bool_and(a.f1 - b.f1 < 0)) AS same_sign FROM seedscore a JOIN "
    f"(SELECT seed, f1 FROM seedscore WHERE config = 'current') b USING (seed) GROUP BY config", "seedscore"))
def _(spark, d):
    x = predictions(spark, d)
    s = lambda p, n: x.groupBy(F.col("grp").alias("seed")).agg(F.avg(E(f"CAST({p} = label AS DOUBLE)")).alias("f1")).withColumn("config", F.lit(n))
    return rounded(M.paired_diff(s("pred", "current").unionByName(s("base_pred", "other")), "current"))


# ---- ranking and joins -----------------------------------------------------------------------------------------

@query("top_customers", "SELECT o_custkey, (round(sum(o_totalprice), 2) + CAST(0 AS DOUBLE)) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, "
                        "o_custkey LIMIT 20")
def _(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return rounded(M.top_n(t, [F.desc("total"), "o_custkey"], 20), 2)


@query("lag_and_lead", with_ctes("SELECT event_id, lag(x) OVER w AS prev, lead(x, 2) OVER w AS next2 FROM samples WINDOW w AS (PARTITION BY rec ORDER BY idx)", "samples"))
def _(spark, d):
    rows = shifted(samples(spark, d).select("rec", "event_id", "idx", "x"), "x", 1, "rec", out="prev", chunk=16)
    return shifted(rows, "x", -2, "rec", out="next2", chunk=16).select("event_id", "prev", "next2")


@query("group_window_aggregate", with_ctes("SELECT event_id, max(x) OVER (PARTITION BY rec) AS top FROM ev_rows", "ev_rows"))
def _(spark, d):
    return M.group_window(events(spark, d).select("rec", "event_id", "x"), "x", "max", "rec", "top").select("event_id", "top")


@query("exact_quantiles", f"SELECT l_returnflag, 0.25::DOUBLE AS q, {r('quantile_cont(l_extendedprice, 0.25)', 4)} AS l_extendedprice FROM lineitem GROUP BY 1 UNION ALL "
                          f"SELECT l_returnflag, 0.5, {r('quantile_cont(l_extendedprice, 0.5)', 4)} FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.25, 0.5]), 4)


cte("edist", "SELECT a.grp, a.clip_id AS src, b.clip_id AS dst, 1 - list_dot_product(a.f, b.f) / (sqrt(list_dot_product(a.f, a.f)) * sqrt(list_dot_product(b.f, b.f))) AS d1, "
             "list_distance(a.f, b.f) AS d2 FROM emb a JOIN emb b ON a.grp = b.grp AND a.clip_id <> b.clip_id", "emb")
cte("ranks", "SELECT *, row_number() OVER (PARTITION BY src ORDER BY d1, dst) - 1 AS r1, row_number() OVER (PARTITION BY src ORDER BY d2, dst) - 1 AS r2, "
             "row_number() OVER (PARTITION BY dst ORDER BY d1, src) - 1 AS c1 FROM edist", "edist")


def dists():
    return {"cos": J.cosine_distance("f", "f"), "euc": J.euclidean_distance("f", "f")}


@query("nearest_by_euclidean", with_ctes(f"SELECT src, dst, {I.format('r2 + 1')} AS rank, {r('d2')} AS d FROM ranks WHERE r2 < 5", "ranks"))
def _(spark, d):
    return rounded(J.nearest(emb(spark, d), "grp", 5, dists()["euc"], ["f"]).select("src", "dst", "rank", "d"))


def candidates(spark, d):
    return kept(spark, d, "candidates", lambda: J.pair_candidates(emb(spark, d), "grp", 4, dists(), ["f"]))


@query("pair_candidates", with_ctes("SELECT grp, src, dst FROM ranks WHERE r1 < 4 OR r2 < 4", "ranks"))
def _(spark, d):
    return candidates(spark, d)


@query("rank_by_row_and_column", with_ctes("SELECT src, dst, r1 AS row_rank, c1 AS col_rank FROM ranks WHERE r1 < 4 OR r2 < 4", "ranks"))
def _(spark, d):
    return J.pair_ranks(candidates(spark, d), emb(spark, d), ["grp"], dists()["cos"], ["f"]).select("src", "dst", "row_rank", "col_rank")


@query("best_rank_sum", with_ctes("SELECT src, dst, r1 + r2 AS total FROM ranks QUALIFY row_number() OVER (PARTITION BY src ORDER BY r1 + r2, dst) = 1", "ranks"))
def _(spark, d):
    return J.best_rank_sum(emb(spark, d), ["grp"], dists(), ["f"], k=4).select("src", "dst", "total")


cte("succ", "SELECT a.clip_id AS src, b.clip_id AS dst FROM emb a JOIN emb b ON b.clip_id = a.clip_id + 5", "emb")


@query("successor_join", with_ctes("SELECT src AS clip_id, dst AS next_id FROM succ", "succ"))
def _(spark, d):
    return J.successor(emb(spark, d).select("clip_id", "grp", F.col("clip_id").alias("start")), 5, "grp").select("clip_id", "next_id")


@query("rank_of_true_successor", with_ctes("SELECT src, dst, r1 AS rank FROM ranks JOIN succ USING (src, dst)", "ranks", "succ"))
def _(spark, d):
    truth = J.successor(emb(spark, d).select("clip_id", "grp", F.col("clip_id").alias("start")), 5, "grp") \
        .selectExpr("clip_id AS src", "next_id AS dst")
    return kept(spark, d, "true_ranks", lambda: J.rank_of_true(emb(spark, d), truth, ["grp"], dists()["cos"], ["f"]).select("src", "dst", "rank"))


@query("successor_hit_rates", with_ctes(
    f"SELECT count(*) AS n, {r('avg(CAST(r1 < 1 AS INT))')} AS hit_1, {r('avg(CAST(r1 < 10 AS INT))')} AS hit_10 FROM ranks JOIN succ USING (src, dst)", "ranks", "succ"))
def _(spark, d):
    from clipgraph.registry.core import QUERIES

    return rounded(J.hit_rates(QUERIES["rank_of_true_successor"](spark, d), [1, 10]))


@query("nearest_margin", with_ctes(
    f"SELECT src, min(CASE WHEN r2 = 0 THEN dst END) AS dst, {r('(max(d2) - min(d2)) / (abs(max(d2)) + 1e-6)')} AS margin FROM ranks WHERE r2 < 2 GROUP BY src", "ranks"))
def _(spark, d):
    return rounded(J.margin(emb(spark, d), "grp", dists()["euc"], ["f"]).select("src", "dst", "margin"))


cte("cand", "SELECT src, dst, d1 AS d FROM ranks WHERE r1 < 4 OR r2 < 4", "ranks")


def costs(spark, d):
    """All candidates with their cosine distance."""
    expr = {"d": f"1 - {A.cosine('a_f', 'b_f')}"}
    return kept(spark, d, "costs", lambda: J.pair_values(candidates(spark, d).select("src", "dst"), emb(spark, d), expr, ["f"]))


@query("mutual_best_pairs", with_ctes(
    f"SELECT src, dst, {r('d')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS a, row_number() OVER (PARTITION BY dst ORDER BY d, src) AS b, "
    f"lead(d) OVER (PARTITION BY src ORDER BY d, dst) AS s FROM cand) WHERE a = 1 AND b = 1 AND (s IS NULL OR d / (s + 1e-9) < 0.97) AND d < 0.8", "cand"))
def _(spark, d):
    return rounded(J.mutual_best(costs(spark, d), 0.97, 0.8).select("src", "dst", "d"))


@query("match_one_to_one")
def _(spark, d):
    return rounded(J.match_one_to_one(costs(spark, d), 0.9))


@query("cheapest_matching")
def _(spark, d):
    from clipgraph.operators.assignment import cheapest_matching

    return rounded(cheapest_matching(costs(spark, d), 0.9).select("src", "dst", "d"))


@query("cheapest_matching_cost", """WITH RECURSIVE pairs AS (SELECT s_nationkey AS nation, s_suppkey AS src, c_custkey AS dst, CAST(abs(s_acctbal - c_acctbal) AS DOUBLE) / 1000 AS d
FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(s_acctbal - c_acctbal) < 300),
srcs AS (SELECT nation, src, row_number() OVER (PARTITION BY nation ORDER BY src) AS i, count(*) OVER (PARTITION BY nation) AS n FROM (SELECT DISTINCT nation, src FROM pairs)),
walk AS (SELECT DISTINCT nation, 0 AS i, CAST([] AS BIGINT[]) AS used, 0.0::DOUBLE AS cost FROM srcs UNION ALL
SELECT w.nation, w.i + 1, CASE WHEN o.dst IS NULL THEN w.used ELSE list_append(w.used, o.dst) END, w.cost + o.d FROM walk w JOIN srcs s ON s.nation = w.nation AND s.i = w.i + 1
JOIN (SELECT nation, src, CAST(dst AS BIGINT) AS dst, d FROM pairs UNION ALL SELECT nation, src, NULL, 0.3 FROM srcs) o ON o.nation = s.nation AND o.src = s.src WHERE o.dst IS NULL OR NOT list_contains(w.used, o.dst))
SELECT w.nation, s.n AS sources, round(min(w.cost), 5) AS cost FROM walk w JOIN srcs s ON s.nation = w.nation AND s.i = s.n WHERE w.i = s.n GROUP BY ALL""")
def _(spark, d):
    from clipgraph.operators.assignment import cheapest_matching

    # rows meet by strips of the balance, a little wider than the limit: a supplier stands in its own strip and both beside it
    strip = "floor(least(greatest({}, -1e15D), 1e15D) / 301)"
    s = table(spark, d, "supplier").withColumn("_strip", E(f"explode(transform(array(-1L, 0L, 1L), i -> i + {strip.format('s_acctbal')}))"))
    c = table(spark, d, "customer").withColumn("_at", E(strip.format("c_acctbal")))
    near = E("s_nationkey = c_nationkey AND _strip = _at AND abs(s_acctbal - c_acctbal) < 300")
    pairs = s.join(c, near).selectExpr("s_suppkey AS src", "c_custkey AS dst", "CAST(abs(s_acctbal - c_acctbal) AS DOUBLE) / 1000 AS d")
    found = cheapest_matching(pairs, 0.3).select("src", "d")
    sources = s.join(c, near, "left_semi").selectExpr("s_nationkey AS nation", "s_suppkey AS src").distinct().join(found, "src", "left")
    return sources.groupBy("nation").agg(F.count("*").alias("sources"), F.round(F.sum(F.coalesce("d", F.lit(0.3))), 5).alias("cost"))


@query("pair_values", with_ctes(f"SELECT src, dst, label_a = label_b AS same, {r('d2')} AS d FROM (SELECT r.*, a.label AS label_a, b.label AS label_b FROM ranks r JOIN emb a ON "
                                f"a.clip_id = src JOIN emb b ON b.clip_id = dst) WHERE r1 < 4 OR r2 < 4", "ranks", "emb"))
def _(spark, d):
    expr = {"same": "a_label = b_label", "d": A.let(A.sub("a_f", "b_f"), A.norm)}
    return rounded(J.pair_values(candidates(spark, d), emb(spark, d), expr, ["label", "f"]).select("src", "dst", "same", "d"))


@query("align_models", with_ctes(
    f"SELECT clip_id, {r('max(p.v)')} AS a, {r('max(ev.v)')} AS b FROM p JOIN ev USING (clip_id, c) GROUP BY clip_id", "p", "ev"))
def _(spark, d):
    from clipgraph.registry.graphs import runs

    wide = J.align_models(runs(spark, d), ["a", "b"], model="run")
    return rounded(wide.select("clip_id", E("array_max(a)").alias("a"), E("array_max(b)").alias("b")))


@query("probability_lookup", with_ctes(f"SELECT e.clip_id, e.label, {r('max(v)')} AS top FROM emb e JOIN p USING (clip_id) GROUP BY e.clip_id, e.label", "emb", "p"))
def _(spark, d):
    return rounded(J.lookup_probs(labels_of(spark, d), probs(spark, d), ["clip_id"]).select("clip_id", "label", E("array_max(p)").alias("top")))


@query("covered_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND o_orderkey % 1000 < c_nationkey * 40)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("rec"), E("o_orderkey % 1000").alias("sec"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("rec"), E("c_nationkey * 40").alias("n"))
    return J.covered_by(o, c).select("o_orderkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.exclude_groups(table(spark, d, "customer").select("c_custkey"), held, "c_custkey")


@query("leave_one_group_out_mean", with_ctes(
    f"SELECT grp, label, {r('(sum(s) OVER (PARTITION BY label) - s) / (sum(n) OVER (PARTITION BY label) - n)')} AS x FROM (SELECT grp, label, sum(x) AS s, count(*) AS n FROM "
    f"ev_rows GROUP BY ALL)", "ev_rows"))
def _(spark, d):
    return rounded(J.leave_one_out(events(spark, d), "grp", "x", ["label"]))


@query("dimension_join", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = J.with_dim(c, table(spark, d, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return J.with_dim(n, table(spark, d, "region"), "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("common_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, d):
    return J.common_keys([table(spark, d, "documents"), table(spark, d, "labels")], ["doc_id"])


@query("distinct_keys", "SELECT DISTINCT source, lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("union_recordings", "SELECT doc_id AS id, lang AS k FROM documents UNION ALL SELECT conv_id, role FROM conversations")
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("k"))
    return a.unionByName(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("k")))


# ---- graph diagnostics -------------------------------------------------------------------------------------------

cte("kn", "SELECT k.grp, k.src, k.dst, m.mutual, a.label AS sl, b.label AS tl, pa.pred AS sp, pb.pred AS tp FROM knn k JOIN edges m USING (src, dst) JOIN emb a ON a.clip_id = "
          "k.src JOIN emb b ON b.clip_id = k.dst JOIN pred pa ON pa.clip_id = k.src JOIN pred pb ON pb.clip_id = k.dst", "knn", "edges", "emb", "pred")


def clips(spark, d):
    return predictions(spark, d).select("clip_id", "grp", "label", "pred", "base_pred", E("clip_id % 4").alias("sensor"), E("clip_id DIV 5").alias("sec"),
                                        E("CAST(clip_id DIV 50 AS INT)").alias("seg"), F.col("grp").alias("rec"))


@query("neighbor_purity", with_ctes(f"SELECT grp, {r('avg(CAST(sl = tl AS INT))')} AS purity, {r('avg(CAST(src % 4 = dst % 4 AS INT))')} AS same_sensor FROM kn GROUP BY grp", "kn"))
def _(spark, d):
    return rounded(D.neighbor_stats(edges(spark, d), clips(spark, d), by="grp"))


@query("purity_by_time_gap", with_ctes(
    f"SELECT {r('avg(CAST(sl = tl AS INT))')} AS purity, {r('avg(CASE WHEN dt > 10 THEN CAST(sl = tl AS INT) END)')} AS purity_gt_10, {r('avg(CAST(dt > 10 AS INT))')} AS "
    f"share_gt_10, {r('avg(CASE WHEN dt > 50 THEN CAST(sl = tl AS INT) END)')} AS purity_gt_50, {r('avg(CAST(dt > 50 AS INT))')} AS share_gt_50, {r('median(dt)')} AS median_gap "
    f"FROM (SELECT *, abs(src // 5 - dst // 5) AS dt FROM kn)", "kn"))
def _(spark, d):
    return rounded(D.purity_by_time(edges(spark, d), clips(spark, d), [10.0, 50.0]))


@query("shifted_label_purity", with_ctes(
    f"SELECT {I.format('s.s')} AS shift, {r('avg(CAST(a.label = b.label AS INT))')} AS purity, count(*) AS n FROM kn, (VALUES (-1), (0), (1), (3)) AS s(s) JOIN emb a ON "
    f"a.clip_id = src + 5 * s.s JOIN emb b ON b.clip_id = dst + 5 * s.s GROUP BY s.s", "kn", "emb"))
def _(spark, d):
    return rounded(D.shifted_purity(edges(spark, d), clips(spark, d), [-1, 0, 1, 3]))


@query("segment_purity", with_ctes(
    "SELECT grp, " + r("avg(CAST(sl = tl AS INT))") + " AS purity, " + r("avg(CAST(src // 50 = dst // 50 AS INT))") + " AS same_segment, "
    + r("avg(CASE WHEN sl = tl THEN CAST(src // 50 = dst // 50 AS INT) END)") + " AS same_segment_given_label FROM kn GROUP BY grp", "kn"))
def _(spark, d):
    return rounded(D.segment_purity(edges(spark, d), clips(spark, d), by="grp"))


cte("xk", "SELECT a.grp, a.src, a.dst, e.label AS sl, a.y AS tl FROM anchorrank a JOIN emb e ON e.clip_id = a.src WHERE a.rank <= 10", "anchorrank", "emb")


@query("cross_group_purity", with_ctes(
    f"SELECT x.grp, {r('purity')} AS purity, {r('chance')} AS chance FROM (SELECT grp, avg(CAST(sl = tl AS INT)) AS purity FROM xk GROUP BY grp) x JOIN (SELECT n.grp, sum(n.n / g.n "
    f"* (t.n - n.n) / ((SELECT count(*) FROM emb) - g.n)) AS chance FROM (SELECT grp, label, count(*)::DOUBLE AS n FROM emb GROUP BY ALL) n JOIN (SELECT grp, count(*)::DOUBLE AS n FROM "
    f"emb GROUP BY grp) g ON g.grp = n.grp JOIN (SELECT label, count(*)::DOUBLE AS n FROM emb GROUP BY label) t ON t.label = n.label GROUP BY n.grp) c ON c.grp = x.grp", "xk", "emb"))
def _(spark, d):
    cross = K.cross_group_knn(emb(spark, d), emb(spark, d), KNN)
    return rounded(D.cross_purity(cross, emb(spark, d)))


cte("indeg", "SELECT e.clip_id, e.grp, count(k.src)::DOUBLE AS deg, any_value(CAST(p.pred <> e.label AS INT)) AS err FROM emb e LEFT JOIN knn k ON k.dst = e.clip_id JOIN pred p ON "
             "p.clip_id = e.clip_id GROUP BY e.clip_id, e.grp", "emb", "knn", "pred")


@query("hubness", with_ctes(
    f"SELECT grp, {r('avg(pow(deg - mu, 3)) / (pow(any_value(sd), 3) + 1e-9)')} AS skew, {r('max(deg) / 10')} AS max_over_k, {r('avg(CASE WHEN deg >= q THEN err END) - avg(err)')} AS "
    f"hub_error_excess FROM (SELECT *, avg(deg) OVER g AS mu, stddev_pop(deg) OVER g AS sd, quantile_cont(deg, 0.95) OVER g AS q FROM indeg WINDOW g AS (PARTITION BY grp)) GROUP BY grp", "indeg"))
def _(spark, d):
    return rounded(D.hubness(edges(spark, d), clips(spark, d), KNN))


@query("rescue_rate", with_ctes(f"SELECT grp, {r('avg(CAST(tp = tl AS INT))')} AS rescue, count(*) AS n FROM kn WHERE sp <> sl AND sl = tl GROUP BY grp", "kn"))
def _(spark, d):
    return rounded(D.rescue_rate(edges(spark, d), clips(spark, d), by="grp"))


@query("cross_class_share", with_ctes(f"SELECT {r('1 - avg(CAST(sl = tl AS INT))')} AS cross_share FROM kn WHERE mutual", "kn"))
def _(spark, d):
    return rounded(D.cross_share(edges(spark, d), clips(spark, d)))


@query("class_purity", with_ctes(f"SELECT sl AS label, {r('avg(CAST(sl = tl AS INT))')} AS purity FROM kn WHERE mutual AND sl <> 0 GROUP BY sl", "kn"))
def _(spark, d):
    return rounded(D.class_purity(edges(spark, d), clips(spark, d)))


cte("nbrh", "SELECT e.clip_id, e.label, c.c, count(k.src) FILTER (k.tl = c.c) AS h, coalesce(sum(q.v), 0) AS m FROM emb e CROSS JOIN range(10) AS c(c) LEFT JOIN (SELECT * FROM kn WHERE "
            "mutual) k ON k.src = e.clip_id LEFT JOIN p q ON q.clip_id = k.dst AND q.c = c.c GROUP BY e.clip_id, e.label, c.c", "emb", "kn", "p")


@query("rival_statistics", with_ctes(
    f"SELECT clip_id, {r('sum(CASE WHEN c = label THEN h END) / greatest(sum(h), 1)')} AS purity, {r('max(CASE WHEN c <> label THEN h ELSE 0 END) / greatest(sum(h), 1)')} AS rival, "
    f"{r('max(CASE WHEN c <> label THEN h END) / nullif(sum(CASE WHEN c <> label THEN h ELSE 0 END), 0)')} AS concentration, (arg_max(c, struct_pack(v := h, n := -c)) = label AND sum(h) > "
    f"0) AS majority_correct, (arg_max(c, struct_pack(v := m, n := -c)) = label AND sum(h) > 0) AS mean_p_correct FROM nbrh GROUP BY clip_id, label", "nbrh"))
def _(spark, d):
    rows = clips(spark, d).join(probs(spark, d).select("clip_id", "p"), "clip_id")
    return rounded(D.rival_stats(edges(spark, d), rows, N_CLASSES))


@query("hard_edges", with_ctes(
    f"SELECT src AS clip_id, {r('sum(CASE WHEN sl <> tl THEN coalesce(rate, 0) ELSE 0 END) / count(*)')} AS hard, {r('avg(CASE WHEN sl <> tl THEN coalesce(rate, 0) END)')} AS mean_rate, "
    f"{r('avg(CAST(sl <> tl AS INT))')} AS cross_share FROM kn LEFT JOIN confus ON a = sl AND b = tl WHERE mutual GROUP BY src", "kn", "confus"))
def _(spark, d):
    conf = M.confusability(M.confusion(predictions(spark, d), "label", "pred"), "label", "pred")
    return rounded(D.hard_edges(edges(spark, d), clips(spark, d), conf))


cte("sameerr", "SELECT e.clip_id, e.pred <> e.label AS wrong, coalesce(avg(CAST(k.sl = k.tl AS INT)), 0) AS pur, coalesce(avg(q.v), 0) AS sig, coalesce(avg(CAST(k.sp = k.tp AS INT)), 0) AS "
               "err FROM pred e LEFT JOIN (SELECT * FROM kn WHERE mutual) k ON k.src = e.clip_id LEFT JOIN p q ON q.clip_id = k.dst AND q.c = e.label GROUP BY e.clip_id, e.pred, e.label",
    "pred", "kn", "p")


@query("same_error_rate", with_ctes(f"SELECT {r('avg(pur)')} AS purity, {r('avg(sig)')} AS signal, {r('avg(CASE WHEN wrong THEN err END)')} AS same_error FROM sameerr", "sameerr"))
def _(spark, d):
    rows = clips(spark, d).join(probs(spark, d).select("clip_id", "p"), "clip_id")
    return rounded(D.same_error(edges(spark, d), rows))


cte("ncells", "SELECT a.a, b.b, coalesce((SELECT avg(CAST(tl = b.b AS INT)) FROM kn WHERE sl = a.a), 0) AS nbr, coalesce((SELECT avg(CAST(pred = b.b AS INT)) FROM pred WHERE label = a.a), "
              "0) AS conf, (1 - (SELECT avg(CAST(sl = tl AS INT)) FROM kn)) * (SELECT count(*) FROM emb WHERE label = b.b) / ((SELECT count(*) FROM emb) - (SELECT count(*) FROM emb WHERE "
              "label = a.a)) AS nul FROM range(10) a(a), range(10) b(b)", "kn", "pred", "emb")


@query("neighbor_matrix_vs_confusion", with_ctes(f"SELECT {r('corr(nbr, conf)')} AS r, {r('corr(nul, conf)')} AS r_null FROM ncells WHERE a <> b", "ncells"))
def _(spark, d):
    return rounded(D.neighbor_vs_confusion(edges(spark, d), clips(spark, d), N_CLASSES))


cte("mdeg", "SELECT e.clip_id, e.grp, e.pred <> e.label AS wrong, count(k.src) AS deg FROM pred e LEFT JOIN (SELECT * FROM edges WHERE mutual) k ON k.src = e.clip_id GROUP BY ALL", "pred", "edges")


@query("isolated_rows", with_ctes(
    f"SELECT grp, {r('avg(deg)')} AS mean_degree, {r('avg(CAST(deg = 0 AS INT))')} AS isolated, {r('avg(CASE WHEN wrong THEN CAST(deg = 0 AS INT) END)')} AS isolated_wrong FROM mdeg GROUP BY grp",
    "mdeg"))
def _(spark, d):
    return rounded(D.isolation(edges(spark, d), clips(spark, d), by="grp"))


@query("fixed_and_broken", with_ctes(
    "SELECT grp, count(*) FILTER (base_pred <> label AND pred = label) AS fixed, count(*) FILTER (base_pred = label AND pred <> label) AS broken, count(*) FILTER (base_pred <> label AND pred = "
    "label) - count(*) FILTER (base_pred = label AND pred <> label) AS net FROM pred GROUP BY grp", "pred"))
def _(spark, d):
    x = clips(spark, d)
    return D.transitions(x.drop("pred").withColumnRenamed("base_pred", "pred"), x, by="grp")


@query("surrounding_class", with_ctes(
    f"SELECT clip_id, label, {I.format('arg_max(c, struct_pack(v := h, n := -c)) FILTER (c <> label)')} AS dominant, {r('max(h) FILTER (c <> label) / sum(h)')} AS share FROM nbrh GROUP BY "
    f"clip_id, label HAVING max(h) FILTER (c <> label) > 0", "nbrh"))
def _(spark, d):
    return rounded(D.surrounding_class(edges(spark, d), clips(spark, d)))


f1_cte("agreef1", "pred", "", N_CLASSES, "base_pred", "pred")


@query("judge_agreement", with_ctes(
    f"SELECT {r('(SELECT f1 FROM agreef1)')} AS agree_f1, {r('(SELECT avg(CAST(pred = 0 AS INT)) FROM pred)')} AS null_rate, {r('(SELECT avg(CAST(base_pred = 0 AS INT)) FROM pred)')} AS "
    f"judge_null_rate, {r('(max(a) - min(a)) / (max(b) - min(b) + 1e-9)')} AS spread_ratio, {r('corr(a, b)')} AS rate_corr FROM (SELECT avg(CAST(pred = 0 AS INT)) AS a, avg(CAST(base_pred = "
    f"0 AS INT)) AS b FROM pred GROUP BY grp)", "agreef1", "pred"))
def _(spark, d):
    return rounded(D.agreement(predictions(spark, d), "pred", "base_pred", N_CLASSES).select("agree_f1", "null_rate", "judge_null_rate", "spread_ratio", "rate_corr"))


f1_cte("basef1", "pred", "grp", N_CLASSES, "label", "base_pred")


@query("group_report", with_ctes(
    f"SELECT grp, {r('b.f1')} AS base_f1, {r('f.f1')} AS final_f1, {r('k.purity')} AS purity, {r('n.null_rate')} AS null_rate FROM basef1 b JOIN pg f USING (grp) JOIN (SELECT grp, avg(CAST(sl = "
    f"tl AS INT)) AS purity FROM kn GROUP BY grp) k USING (grp) JOIN (SELECT grp, avg(CAST(label = 0 AS INT)) AS null_rate FROM emb GROUP BY grp) n USING (grp)", "basef1", "pg", "kn", "emb"))
def _(spark, d):
    return rounded(D.group_report(clips(spark, d), edges(spark, d), N_CLASSES))


f1_cte("bcls", "pred", "", N_CLASSES, "label", "base_pred")


@query("per_class_report", with_ctes(
    "SELECT CAST(k AS INT) AS class, " + r("2 * a.tp / (a.sup + a.prd)") + " AS f1_pred, " + r("2 * b.tp / (b.sup + b.prd)") + " AS f1_base_pred, "
    + r("greatest(2 * a.tp / (a.sup + a.prd), 2 * b.tp / (b.sup + b.prd))") + " AS best FROM pf_cls a JOIN bcls_cls b USING (k)", "pf_cls", "bcls_cls"))
def _(spark, d):
    return rounded(D.per_class_report(predictions(spark, d), ["pred", "base_pred"]))


cte("sides", "SELECT k, " + ", ".join(f"coalesce(2.0 * {x}.tp / ({x}.sup + {x}.prd), 0) AS {n}" for x, n in (("a", "f"), ("b", "g")))
    + ", coalesce(s.arm, 0) AS arm, coalesce(s.leg, 0) AS leg FROM range(10) AS t(k) LEFT JOIN pf_cls a USING (k) LEFT JOIN bcls_cls b USING (k) LEFT JOIN (SELECT label AS k, "
    "avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END) FILTER (clip_id % 4 < 2) AS arm, avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END) FILTER (clip_id % 4 >= 2) AS leg "
    "FROM pred GROUP BY label) s USING (k)", "pf_cls", "bcls_cls", "pred")
_columns = (("f", "f1_pred"), ("g", "f1_base_pred"), ("greatest(f, g)", "best"), ("arm", "recall_arm"), ("leg", "recall_leg"))


@query("per_class_report_by_side", with_ctes(
    "SELECT CAST(k AS INT) AS class, " + ", ".join(f"{r(x)} AS {n}" for x, n in _columns) + " FROM sides UNION ALL SELECT NULL, "
    + ", ".join(r(f"avg({x})") for x, _ in _columns) + " FROM sides", "sides"))
def _(spark, d):
    rows = predictions(spark, d).withColumn("side", E("IF(clip_id % 4 < 2, 'arm', 'leg')"))
    return rounded(D.per_class_sides(rows, ["pred", "base_pred"], "side", ["arm", "leg"], N_CLASSES))


cte("variants", "SELECT 'as is' AS variant, label, pred FROM pred UNION ALL SELECT 'excluded', label, pred FROM pred WHERE NOT (grp = 2 AND clip_id // 5 >= 20) UNION ALL SELECT 'shifted', "
                "coalesce(l.label, p.label), pred FROM pred p LEFT JOIN emb l ON l.clip_id = p.clip_id + 15 AND p.grp = 1", "pred", "emb")
f1_cte("variantf1", "variants", "variant")


@query("label_defect_sensitivity", with_ctes(f"SELECT variant, {r('f1')} AS f1 FROM variantf1", "variantf1"))
def _(spark, d):
    from clipgraph.operators.filters import exclude_ranges, shift_labels

    rows = clips(spark, d).select("rec", "sec", "label", "pred")
    return rounded(D.label_sensitivity(rows, {"excluded": exclude_ranges(rows, [(2, 20, None)]), "shifted": shift_labels(rows, [1], 3)}, N_CLASSES))


cte("hourly", "SELECT sensor, hour, avg(x) AS v FROM ev_rows GROUP BY ALL", "ev_rows")


@query("best_matching_series", with_ctes(
    f"SELECT a, b, {r('r')} AS r, n, {I.format('rank')} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC NULLS LAST, b) AS rank FROM (SELECT x.sensor AS a, y.sensor AS b, "
    f"corr(x.v, y.v) AS r, count(*) AS n FROM hourly x JOIN hourly y USING (hour) GROUP BY ALL) WHERE n > 20) WHERE rank <= 2", "hourly"))
def _(spark, d):
    h = events(spark, d).groupBy("sensor", F.col("hour").alias("sec")).agg(F.avg("x").alias("change"))
    return rounded(J.match_series(h.withColumnRenamed("sensor", "a"), h.withColumnRenamed("sensor", "b"), "a", "b", min_n=20))




# ---- experiments -------------------------------------------------------------------------------------------------

@query("parameter_sweep")
def _(spark, d):
    return rounded(plans.sweep([(emb(spark, d), probs(spark, d), evidence(spark, d))], labels_of(spark, d), {"k": [15, 20], "temp": [1.2]}, N_CLASSES))


@query("base_graph_table")
def _(spark, d):
    e = emb(spark, d)
    bases = {"anchors": probs(spark, d), "evidence": evidence(spark, d)}
    return rounded(plans.base_graph_table(bases, {"none": None, "embedding": e}, labels_of(spark, d), N_CLASSES, stages=(), k=KNN, iters=2))


@query("refine_in_parts")
def _(spark, d):
    return long(plans.refine_parts(emb(spark, d), probs(spark, d), evidence(spark, d), 2, ["clip_id"], drop=3, k=KNN, iters=2, stages=()))
