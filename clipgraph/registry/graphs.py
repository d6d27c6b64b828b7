"""Graph construction and propagation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import graph as G
from clipgraph.operators import knn as K
from clipgraph.operators import vectors as V
from clipgraph.plans.refine import refine
from clipgraph.registry.core import (KNN, N_CLASSES, E, cte, edge_ctes, edges, emb, evidence, kept, labels_of, long, pool_cte,
                                     probs, query, r, rebuild_ctes, rounded, sharpen_cte, step_ctes, weights, with_ctes)

EDGE = "SELECT src, dst, {sim} AS sim, mutual FROM {e}"
PV = "SELECT clip_id, CAST(c AS INT) AS c, {v} AS v FROM {q}"


def edges_sql(prefix: str) -> str:
    return with_ctes(EDGE.format(sim=r("sim"), e=f"{prefix}edges"), f"{prefix}edges")


def pv_sql(q: str) -> str:
    return with_ctes(PV.format(v=r("v"), q=q), q)


def flat(e):
    return rounded(e.select("src", "dst", "sim", "mutual"))


@query("knn_cosine", with_ctes(f"SELECT grp, src, dst, CAST(rank AS INT) AS rank, {r('sim')} AS sim FROM knn", "knn"))
def _(spark, d):
    return rounded(edges(spark, d).select("grp", "src", "dst", "rank", "sim"))


@query("mutual_knn", edges_sql(""))
def _(spark, d):
    return flat(edges(spark, d))


@query("pruned_knn", edges_sql(""))
def _(spark, d):
    """Exact search with cells of about twenty rows; at cluster size a cell holds thousands."""
    return flat(K.knn_pruned(emb(spark, d), "grp", KNN, cell_rows=20))


@query("edge_weights", with_ctes(f"SELECT src, dst, {r('w')} AS w FROM w WHERE w > 0", "w"))
def _(spark, d):
    return rounded(weights(spark, d).where("w > 0").select("src", "dst", "w"))


LAST = step_ctes("q_a", "w", "p", 3, 0.75)


@query("propagate", pv_sql(LAST))
def _(spark, d):
    return long(G.propagate(probs(spark, d), edges(spark, d), 0.75, 3))


cte("conf", "SELECT clip_id, any_value(grp) AS grp, max(v) AS m FROM p GROUP BY clip_id", "p")
cte("wconf", "SELECT grp, src, dst, x / (sum(x) OVER (PARTITION BY src) + 1e-12) AS w FROM (SELECT w.grp, src, dst, w * m AS x FROM w "
             "JOIN conf ON conf.clip_id = dst)", "w", "conf")
LAST = step_ctes("q_c", "wconf", "p", 2, 0.75)


@query("propagate_confidence_weighted", pv_sql(LAST))
def _(spark, d):
    return long(G.propagate(probs(spark, d), edges(spark, d), 0.75, 2, conf_pow=1.0))


def node_alpha(prefix: str, alpha: str, iters: int) -> str:
    prev = "p"
    for i in range(1, iters + 1):
        cte(f"{prefix}{i}", f"SELECT b.grp, b.clip_id, b.c, (1 - n.a) * b.v + n.a * coalesce(s.v, 0) AS v FROM p b JOIN {alpha} n USING "
                            f"(clip_id) LEFT JOIN (SELECT e.src, q.c, sum(e.w * q.v) AS v FROM w e JOIN {prev} q ON q.clip_id = e.dst "
                            f"GROUP BY e.src, q.c) s ON s.src = b.clip_id AND s.c = b.c", "p", alpha, "w", prev)
        prev = f"{prefix}{i}"
    return prev


cte("alpha_conf", "SELECT clip_id, greatest(0, least(0.99, 0.75 + 0.25 * 0.5 * (1 - (m - min(m) OVER g) / (max(m) OVER g - min(m) OVER g "
                  "+ 1e-9)))) AS a FROM conf WINDOW g AS (PARTITION BY grp)", "conf")
cte("alpha_node", "SELECT clip_id, greatest(0, least(0.99, 0.75 + 0.25 * 0.8 * (u - min(u) OVER g) / (max(u) OVER g - min(u) OVER g "
                  "+ 1e-9))) AS a FROM (SELECT clip_id, grp, f[1] AS u FROM emb) WINDOW g AS (PARTITION BY grp)", "emb")


@query("propagate_confidence_alpha", pv_sql(node_alpha("q_ca", "alpha_conf", 2)))
def _(spark, d):
    return long(G.propagate(probs(spark, d), edges(spark, d), 0.75, 2, conf_alpha=0.5))


@query("propagate_node_uncertainty", pv_sql(node_alpha("q_nu", "alpha_node", 2)))
def _(spark, d):
    rows = probs(spark, d).join(emb(spark, d).select("clip_id", E("f[0]").alias("u")), "clip_id")
    return long(G.propagate(rows, edges(spark, d), 0.75, 2, node_u="u", u_beta=0.8))


# two stages of one step each, with the rebuilt graph in between
def stage_ctes(prefix: str, first: str, lam: float, iters: int, temp: float, inject=None, every: bool = False, once: bool = False,
               last: bool = False, rebuild: str | None = None) -> str:
    q = step_ctes(f"{prefix}s", "w", first, iters, 0.75)
    sharpen_cte(f"{prefix}h", q, temp)
    q = f"{prefix}h"
    evs = inject or []
    if every or once:
        for n, (ev, g) in enumerate(evs):
            pool_cte(f"{prefix}v{n}", q, ev, g / (2 if every else 1))
            q = f"{prefix}v{n}"
    wname = "w" if rebuild == "none" else rebuild_ctes(f"{prefix}g", rebuild or q, lam)
    q = step_ctes(f"{prefix}t", wname, q, iters, 0.75)
    sharpen_cte(f"{prefix}u", q, temp)
    q = f"{prefix}u"
    if every or last:
        for n, (ev, g) in enumerate(evs):
            pool_cte(f"{prefix}z{n}", q, ev, g / (2 if every else 1))
            q = f"{prefix}z{n}"
    return q


def run(spark, d, **kw):
    base = kw.pop("probs", None)
    return G.multistage(base if base is not None else probs(spark, d), emb(spark, d), [4.0], k=KNN, iters=2, temp=1.4,
                        first_edges=edges(spark, d), **kw)


@query("multistage", pv_sql(stage_ctes("ms_", "p", 4.0, 2, 1.4)))
def _(spark, d):
    return long(run(spark, d))


@query("multistage_evidence_every", pv_sql(stage_ctes("me_", "p", 4.0, 2, 1.4, [("ev", 0.2)], every=True)))
def _(spark, d):
    return long(kept(spark, d, "refined", lambda: run(spark, d, evidence=evidence(spark, d), g=0.2, where="every")))


@query("multistage_evidence_last", pv_sql(stage_ctes("ml_", "p", 4.0, 2, 1.4, [("ev", 0.2)], last=True)))
def _(spark, d):
    return long(run(spark, d, evidence=evidence(spark, d), g=0.2, where="last"))


@query("multistage_evidence_once", pv_sql(stage_ctes("mo_", "p", 4.0, 2, 1.4, [("ev", 0.2)], once=True)))
def _(spark, d):
    return long(run(spark, d, evidence=evidence(spark, d), g=0.2, where="once"))


@query("multistage_two_evidence_tables", pv_sql(stage_ctes("m2_", "p", 4.0, 2, 1.4, [("ev", 0.2), ("p", 0.1)], every=True)))
def _(spark, d):
    return long(run(spark, d, evidence=[(evidence(spark, d), 0.2), (probs(spark, d), 0.1)], where="every"))


@query("rebuild_none", pv_sql(stage_ctes("rn_", "p", 4.0, 2, 1.4, rebuild="none")))
def _(spark, d):
    return long(run(spark, d, rebuild_from="none"))


@query("rebuild_from_initial", pv_sql(stage_ctes("ri_", "p", 4.0, 2, 1.4, rebuild="p")))
def _(spark, d):
    return long(run(spark, d, rebuild_from="initial"))


cte("truth", f"SELECT grp, clip_id, c.c, CASE WHEN label = c.c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM emb, range({N_CLASSES}) AS c(c)", "emb")


@query("rebuild_from_truth", pv_sql(stage_ctes("rt_", "p", 4.0, 2, 1.4, rebuild="truth")))
def _(spark, d):
    truth = emb(spark, d).select("grp", "clip_id", E(A.one_hot("label", N_CLASSES)).alias("p"))
    return long(run(spark, d, rebuild_from="truth", truth=truth))


@query("rebuild_from_permuted")
def _(spark, d):
    return long(run(spark, d, rebuild_from="permuted"))


_first = stage_ctes("ca_", "p", 4.0, 5, 1.4)
sharpen_cte("ca_corr", _first, 1.2)


@query("cascade", pv_sql(stage_ctes("cb_", "ca_corr", 4.0, 5, 1.4)))
def _(spark, d):
    fix = lambda q: q.withColumn("p", E(A.sharpen("p", 1.2)))
    return long(G.cascade(probs(spark, d), emb(spark, d), fix, [4.0], k=KNN, temp=1.4, first_edges=edges(spark, d)))


@query("graph_features", with_ctes(
    f"SELECT clip_id, CAST(pos - 1 AS INT) AS c, {r('f[pos]')} AS v FROM unit, range(1, 65) t(pos) UNION ALL "
    f"SELECT clip_id, CAST(64 + c AS INT), {r('0.5 * sqrt(v)')} FROM p", "unit", "p"))
def _(spark, d):
    return long(G.graph_features(emb(spark, d), probs(spark, d), 0.5), "f")


@query("refined_system")
def _(spark, d):
    out = refine(emb(spark, d), probs(spark, d), evidence(spark, d), drop=5, k=KNN, iters=2, stages=(4.0,))
    return long(out)


cte("dirw", "SELECT grp, src, dst, x / (sum(x) OVER (PARTITION BY src) + 1e-12) AS w FROM (SELECT grp, src, dst, "
            "exp(10 * (sim - max(sim) OVER (PARTITION BY src))) AS x FROM knn)", "knn")
LAST = step_ctes("q_d", "dirw", "p", 2, 0.6)


@query("knn_smooth", pv_sql(LAST))
def _(spark, d):
    return long(G.knn_smooth(probs(spark, d), emb(spark, d), KNN, 0.6, 2))


cte("pairs_s", "SELECT * FROM (SELECT a.grp, a.clip_id AS src, b.clip_id AS dst, list_dot_product(a.f, b.f) AS sim FROM cellunit a JOIN "
               "cellunit b ON a.grp = b.grp AND a.s = b.s AND a.clip_id <> b.clip_id)", "cellunit")
cte("cellunit", "SELECT clip_id, grp, s, list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8)) AS f FROM (SELECT clip_id, "
                "grp, s, list(v - m ORDER BY pos) AS f FROM (SELECT clip_id, grp, clip_id % 4 AS s, pos, v, avg(v) OVER (PARTITION BY grp, "
                "clip_id % 4, pos) AS m FROM coord) GROUP BY clip_id, grp, s)", "coord")
edge_ctes("sens_", "pairs_s", 5)


def by_sensor(spark, d):
    return K.knn(emb(spark, d).withColumn("s", E("clip_id % 4")), ["grp", "s"], 5).drop("s")


@query("knn_same_sensor", edges_sql("sens_"))
def _(spark, d):
    return flat(by_sensor(spark, d))


@query("union_edges", with_ctes(f"{EDGE.format(sim=r('sim'), e='edges')} UNION ALL {EDGE.format(sim=r('sim'), e='sens_edges')}",
                                "edges", "sens_edges"))
def _(spark, d):
    return flat(K.union_edges(edges(spark, d), by_sensor(spark, d)))


cte("pairs_x", "SELECT grp, src, dst, sim - CASE WHEN src % 4 = dst % 4 THEN 0.3 ELSE 0 END AS sim FROM pairs", "pairs")
edge_ctes("pen_", "pairs_x")


@query("knn_same_sensor_penalty", edges_sql("pen_"))
def _(spark, d):
    return flat(K.knn(emb(spark, d).withColumn("s", E("clip_id % 4")), "grp", KNN, same=("s", 0.3)))


cte("pairs_all", "SELECT a.grp, a.clip_id AS src, b.clip_id AS dst, list_dot_product(a.f, b.f) - CASE WHEN a.grp <> b.grp THEN 0.2 ELSE 0 "
                 "END AS sim FROM rawunit a JOIN rawunit b ON a.clip_id <> b.clip_id", "rawunit")
edge_ctes("shared_", "pairs_all")


@query("knn_shared_graph", edges_sql("shared_"))
def _(spark, d):
    return flat(K.knn(emb(spark, d), None, KNN, center=False, cross=("grp", 0.2)))


cte("two", "SELECT clip_id, grp, clip_id % 4 AS s, f[1:32] AS a, f[33:64] AS b FROM emb", "emb")
cte("twou", "SELECT clip_id, grp, s, list_transform(a, lambda x: x / (sqrt(list_dot_product(a, a)) + 1e-8)) AS a, "
            "list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-8)) AS b FROM two", "two")
cte("twosim", "SELECT x.grp, x.clip_id AS src, y.clip_id AS dst, x.s = y.s AS same, list_dot_product(x.a, y.a) AS sa, "
              "list_dot_product(x.b, y.b) AS sb FROM twou x JOIN twou y ON x.grp = y.grp", "twou")
cte("twocal", "SELECT grp, avg(sa) AS ma, stddev_samp(sa) AS da, avg(sb) AS mb, stddev_samp(sb) AS db FROM twosim WHERE same GROUP BY grp",
    "twosim")
cte("pairs_sw", "SELECT t.grp, src, dst, CASE WHEN same THEN (sb - mb) / db * da + ma ELSE sa END AS sim FROM twosim t JOIN twocal USING "
                "(grp) WHERE src <> dst", "twosim", "twocal")
edge_ctes("sw_", "pairs_sw")


def two_blocks(spark, d):
    return emb(spark, d).select("clip_id", "grp", E("clip_id % 4").alias("s"), E("slice(f, 1, 32)").alias("a"), E("slice(f, 33, 32)").alias("b"))


@query("knn_switched_similarity", edges_sql("sw_"))
def _(spark, d):
    return flat(K.knn_switched(two_blocks(spark, d), "grp", KNN, "a", "b", "s", calibrate=True))


for _m in "ab":
    cte(f"wnn_{_m}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s{_m} DESC, dst) AS rk FROM twosim WHERE "
                     f"src <> dst) WHERE rk <= {KNN}", "twosim")
    for _f in "ab":
        cte(f"near_{_m}{_f}", f"SELECT src, list(v ORDER BY pos) AS f FROM (SELECT e.src, i.pos, avg(u.{_f}[i.pos]) AS v FROM wnn_{_m} e JOIN "
                              f"twou u ON u.clip_id = e.dst, range(1, 33) AS i(pos) GROUP BY e.src, i.pos) GROUP BY src", f"wnn_{_m}", "twou")
_aff = lambda f, m: f"list_dot_product(u.{f}, n{m}{f}.f) / (sqrt(list_dot_product(n{m}{f}.f, n{m}{f}.f)) + 1e-8)"
cte("wnnw", f"SELECT u.clip_id, 1 / (1 + exp((({_aff('b', 'b')}) - ({_aff('b', 'a')})) / 0.1 - (({_aff('a', 'a')}) - ({_aff('a', 'b')})) / 0.1)) "
            f"AS w FROM twou u JOIN near_aa naa ON naa.src = u.clip_id JOIN near_ab nab ON nab.src = u.clip_id JOIN near_ba nba ON "
            f"nba.src = u.clip_id JOIN near_bb nbb ON nbb.src = u.clip_id", "twou", "near_aa", "near_ab", "near_ba", "near_bb")
cte("pairs_wnn", "SELECT grp, src, dst, (x.w + y.w) / 2 * sa + (1 - (x.w + y.w) / 2) * sb AS sim FROM twosim JOIN wnnw x ON x.clip_id = src "
                 "JOIN wnnw y ON y.clip_id = dst WHERE src <> dst", "twosim", "wnnw")
edge_ctes("wf_", "pairs_wnn")


@query("knn_weighted_fusion", edges_sql("wf_"))
def _(spark, d):
    return flat(K.knn_weighted_fusion(two_blocks(spark, d), "grp", KNN, "a", "b", 0.1))


cte("rawpairs", "SELECT a.grp, a.clip_id AS src, b.clip_id AS dst, list_dot_product(a.f, b.f) AS sim FROM rawunit a JOIN rawunit b ON "
                "a.grp = b.grp AND a.clip_id <> b.clip_id", "rawunit")
cte("sigma", "SELECT src, greatest(1 - sim, 1e-6) AS s FROM (SELECT src, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rk "
             "FROM rawpairs) WHERE rk = 8", "rawpairs")
cte("lsraw", "SELECT grp, p.src, dst, -(1 - sim) / sqrt(a.s * b.s) AS z FROM rawpairs p JOIN sigma a ON a.src = p.src JOIN sigma b ON b.src = "
             "p.dst", "rawpairs", "sigma")
cte("pairs_ls", "SELECT grp, src, dst, (z - lo) / (hi - lo + 1e-9) AS sim FROM (SELECT *, min(z) OVER (PARTITION BY grp) AS lo, "
                "greatest(0, max(z) OVER (PARTITION BY grp)) AS hi FROM lsraw)", "lsraw")
edge_ctes("ls_", "pairs_ls")


@query("knn_local_scaling", edges_sql("ls_"))
def _(spark, d):
    return flat(K.knn_local_scaling(emb(spark, d), "grp", KNN, 7))


cte("fused", "SELECT any_value(grp) AS grp, src, dst, sum(w) AS w FROM (SELECT grp, src, dst, 0.7 * w AS w FROM w UNION ALL SELECT grp, src, "
             "dst, 0.3 * w FROM sens_w) GROUP BY src, dst", "w", "sens_w")
LAST = step_ctes("q_f", "fused", "p", 2, 0.75)


@query("propagate_fused_graphs", pv_sql(LAST))
def _(spark, d):
    return long(G.propagate_fused(probs(spark, d), [edges(spark, d), by_sensor(spark, d)], [0.7, 0.3], 0.75, 2))


@query("graph_smoothness", with_ctes(
    f"SELECT a.grp, {r('sum(w * pow(a.v - b.v, 2)) / 2')} AS smoothness FROM w JOIN p a ON a.clip_id = w.src JOIN p b ON b.clip_id = w.dst "
    f"AND b.c = a.c GROUP BY a.grp", "w", "p"))
def _(spark, d):
    return rounded(G.smoothness(probs(spark, d), weights(spark, d)))


@query("adaptive_graph_weights")
def _(spark, d):
    _, table = G.adaptive_weights(probs(spark, d), [edges(spark, d), by_sensor(spark, d)], outer=2, iters=2)
    return long(table, "a", ("grp",))


prev = "p"
for _i in range(1, 3):
    cte(f"lame{_i}", f"SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT b.grp, b.clip_id, b.c, "
                     f"greatest(b.v, 1e-9) * exp(0.5 * coalesce(s.v, 0)) AS x FROM p b LEFT JOIN (SELECT e.src, q.c, sum(e.w * q.v) AS v "
                     f"FROM w e JOIN {prev} q ON q.clip_id = e.dst GROUP BY e.src, q.c) s ON s.src = b.clip_id AND s.c = b.c)", "p", "w", prev)
    prev = f"lame{_i}"


@query("propagate_lame_rule", pv_sql("lame2"))
def _(spark, d):
    return long(G.propagate_lame(probs(spark, d), edges(spark, d), 0.5, iters=2))


@query("propagate_lame_converged")
def _(spark, d):
    return long(G.propagate_lame(probs(spark, d), edges(spark, d), 0.5, tol=1e-4, iters=24))


cte("seedlab", f"SELECT grp, clip_id, c.c, CASE WHEN clip_id % 3 <> 0 AND label = c.c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM emb, "
               f"range({N_CLASSES}) AS c(c)", "emb")
cte("lpw", "SELECT grp, src, dst, greatest(sim, 0) / (sum(greatest(sim, 0)) OVER (PARTITION BY src) + 1e-12) AS w FROM edges WHERE mutual", "edges")
LAST = step_ctes("q_lp", "lpw", "seedlab", 3, 0.9)


@query("label_propagation", pv_sql(LAST))
def _(spark, d):
    return long(G.label_propagate(emb(spark, d).withColumn("known", E("clip_id % 3 <> 0")), "known", N_CLASSES, k=KNN, iters=3))


@query("pool_neighbors_by_sensor", with_ctes(
    f"SELECT src, dst % 4 AS sensor, count(*) AS n, CAST(pos - 1 AS INT) AS c, {r('avg(v)')} AS v FROM (SELECT src, dst FROM knn UNION ALL "
    f"SELECT clip_id, clip_id FROM emb) e JOIN coord ON coord.clip_id = e.dst GROUP BY src, dst % 4, pos", "knn", "coord"))
def _(spark, d):
    pooled = K.pool_neighbors(edges(spark, d), emb(spark, d).withColumn("sensor", E("clip_id % 4")), "sensor", "f")
    return long(pooled, "f", ("src", "sensor", "n"))


@query("oracle_average_by_label", with_ctes(
    f"SELECT clip_id, CAST(c AS INT) AS c, {r('avg(v) OVER (PARTITION BY p.grp, label, c)')} AS v FROM p JOIN emb USING (clip_id)", "p", "emb"))
def _(spark, d):
    return long(G.average_by(probs(spark, d).join(labels_of(spark, d), "clip_id"), ["grp", "label"]))


_strong = "SELECT src, dst FROM edges WHERE mutual AND sim > 0.35"
cte("strong", _strong, "edges")
CTES_REACH = ("WITH RECURSIVE {defs}, reach AS (SELECT clip_id AS root, clip_id AS node FROM emb UNION SELECT reach.root, s.dst FROM reach "
              "JOIN strong s ON s.src = reach.node) SELECT root AS clip_id, min(node) AS component FROM reach GROUP BY root")
_defs = with_ctes("SELECT 1", "strong").removeprefix("WITH ").removesuffix("\nSELECT 1")


def clusters(spark, d):
    return G.components(edges(spark, d).where("mutual AND sim > 0.35"), emb(spark, d))


@query("components", CTES_REACH.format(defs=_defs))
def _(spark, d):
    return clusters(spark, d)


@query("blend_cluster_mean")
def _(spark, d):
    return long(G.blend_cluster_mean(probs(spark, d), clusters(spark, d), 0.5))


@query("average_linkage")
def _(spark, d):
    from clipgraph.operators.linkage import average_linkage

    return average_linkage(emb(spark, d), "grp", per=20.0).select("clip_id", "component")


def runs(spark, d):
    a = probs(spark, d).select("grp", "clip_id", "p", F.lit("a").alias("run"))
    return a.unionByName(evidence(spark, d).select("grp", "clip_id", "p", F.lit("b").alias("run")))


cte("tworuns", "SELECT grp, clip_id, c, v FROM p UNION ALL SELECT grp, clip_id, c, v FROM ev", "p", "ev")
cte("arith", "SELECT grp, clip_id, c, avg(v) AS v FROM tworuns GROUP BY grp, clip_id, c", "tworuns")
cte("geo", "SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT grp, clip_id, c, exp(avg(ln(greatest(v, 1e-9)))) AS "
           "x FROM tworuns GROUP BY grp, clip_id, c)", "tworuns")


@query("graph_ensemble_arithmetic", pv_sql("arith"))
def _(spark, d):
    return long(G.ensemble_runs(runs(spark, d)))


@query("graph_ensemble_geometric", pv_sql("geo"))
def _(spark, d):
    return long(G.ensemble_runs(runs(spark, d), "geo"))


@query("anchor_prior", pv_sql("p"))
def _(spark, d):
    return long(probs(spark, d))


@query("edge_diff", with_ctes(
    "SELECT src, dst, 'removed' AS change FROM (SELECT src, dst FROM edges EXCEPT ALL SELECT src, dst FROM pen_edges) UNION ALL "
    "SELECT src, dst, 'added' FROM (SELECT src, dst FROM pen_edges EXCEPT ALL SELECT src, dst FROM edges)", "edges", "pen_edges"))
def _(spark, d):
    other = K.knn(emb(spark, d).withColumn("s", E("clip_id % 4")), "grp", KNN, same=("s", 0.3))
    return K.edge_diff(edges(spark, d), other)
