"""Embedding-table queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import subspace as S
from clipgraph.operators import vectors as V
from clipgraph.registry.core import (DIMS, N_CLASSES, E, cte, emb, events, kept, long, probs, query, r, rounded, with_ctes)

LONG = "SELECT clip_id, CAST(u.pos - 1 AS INT) AS c, {v} AS v FROM {t}, range(1, 65) AS u(pos)"


def long_sql(t: str, *needs: str, f: str = "f") -> str:
    return with_ctes(LONG.format(v=r(f"{f}[u.pos]"), t=t), t, *needs)


@query("l2_normalize", long_sql("rawunit"))
def _(spark, d):
    return long(emb(spark, d).withColumn("f", E(A.l2_normalize("f"))), "f")


@query("center_by_group", long_sql("cen"))
def _(spark, d):
    return long(V.center_by(emb(spark, d), "grp"), "f")


cte("zs", "SELECT clip_id, grp, label, pos, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6) AS v FROM coord "
          "WINDOW w AS (PARTITION BY grp, pos)", "coord")


@query("zscore_by_group", with_ctes(f"SELECT clip_id, CAST(pos - 1 AS INT) AS c, {r('v')} AS v FROM zs", "zs"))
def _(spark, d):
    return long(V.zscore_by(emb(spark, d), "grp"), "f")


@query("zscore_by_group_sensor", with_ctes(
    f"SELECT clip_id, CAST(pos - 1 AS INT) AS c, CASE WHEN count(*) OVER w <= 9 THEN 0 ELSE "
    f"{r('(v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6)')} END AS v FROM coord "
    f"WINDOW w AS (PARTITION BY grp, label, pos)", "coord"))
def _(spark, d):
    return long(V.zscore_by(emb(spark, d), ["grp", "label"], min_rows=9), "f")


cte("gram", "SELECT a.grp, a.pos AS i, b.pos AS j, sum(a.v * b.v) AS g FROM cpos a JOIN cpos b USING (clip_id) "
            "WHERE a.grp = b.grp GROUP BY a.grp, a.pos, b.pos", "cpos")
cte("cpos", "SELECT clip_id, grp, u.pos, f[u.pos] AS v FROM cen, range(1, 65) AS u(pos)", "cen")


@query("gram_by_group", with_ctes(f"SELECT grp, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, {r('g')} AS g FROM gram", "gram"))
def _(spark, d):
    return V.gram_by(emb(spark, d), "grp").select("grp", "i", E("posexplode(g)").alias("j", "g")) \
            .select("grp", "i", "j", F.round("g", 6).alias("g"))


@query("principal_components")
def _(spark, d):
    return S.pca_by(emb(spark, d), "grp", 5)


@query("drop_top_components")
def _(spark, d):
    return long(S.drop_top_pcs(emb(spark, d), "grp", 5), "f")


@query("drop_component_band")
def _(spark, d):
    return long(S.drop_pc_band(emb(spark, d), "grp", 5, 10), "f")


# total variance after removing m directions = total minus the m largest eigenvalues: checked in tests

# a fixed orthonormal basis: two interleaved constant directions
_B = [[1.0 / 32 ** 0.5 if i % 2 == j else 0.0 for i in range(DIMS)] for j in range(2)]


@query("project_out_basis", with_ctes(
    f"SELECT clip_id, CAST(pos - 1 AS INT) AS c, {r('v - avg(v) OVER (PARTITION BY clip_id, pos % 2)')} AS v FROM coord", "coord"))
def _(spark, d):
    basis = spark.createDataFrame([(j, b) for j, b in enumerate(_B)], "j int, b array<double>")
    return long(V.project_out(emb(spark, d), basis), "f")


@query("drop_sensor_subspace")
def _(spark, d):
    return long(S.drop_group_subspace(emb(spark, d).withColumn("sensor", E("clip_id % 4")), "grp", "sensor"), "f")


@query("whiten")
def _(spark, d):
    return long(S.whiten(emb(spark, d), "grp", 16), "f")


@query("truncate_components")
def _(spark, d):
    return long(S.truncate(emb(spark, d), "grp", 16), "f")


def _spread(spark, d):
    return emb(spark, d).withColumn("spread", E(A.let("f", lambda f: f"aggregate(slice({f}, 33, 32), 0D, (s, x) -> s + x * x)")))


@query("weighted_subspace_removal")
def _(spark, d):
    return long(S.drop_weighted_pcs(_spread(spark, d), "grp", 5, "spread", "weighted"), "f")


@query("trimmed_subspace_removal")
def _(spark, d):
    return long(S.drop_weighted_pcs(_spread(spark, d), "grp", 5, "spread", "trim", 0.7), "f")


@query("drop_channels_by_variance", with_ctes(
    f"SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS INT) AS c, {r('v')} AS v FROM coord "
    f"JOIN (SELECT grp, i AS pos, row_number() OVER (PARTITION BY grp ORDER BY g DESC, i) AS rk FROM gram WHERE i = j) k "
    f"USING (grp, pos) WHERE rk > 8", "coord", "gram"))
def _(spark, d):
    return long(S.drop_channels(emb(spark, d), "grp", "variance", 8), "f")


@query("drop_channels_by_energy")
def _(spark, d):
    return long(S.drop_channels(emb(spark, d), "grp", "energy", 8, m=5), "f")


@query("spectrum_summary")
def _(spark, d):
    return rounded(S.spectrum(emb(spark, d), "grp"))


@query("mean_pair_cosine", with_ctes(f"SELECT grp, {r('avg(sim)')} AS mean_cos FROM pairs GROUP BY grp", "pairs"))
def _(spark, d):
    return rounded(S.mean_pair_cosine(emb(spark, d), "grp"))


cte("first_axis", "SELECT clip_id, grp, label, f[1] AS v, clip_id AS t FROM emb", "emb")


def _first(spark, d):
    return emb(spark, d).select("clip_id", "grp", "label", E("f[0]").alias("v"), F.col("clip_id").cast("double").alias("t"))


@query("eta2_by_label", with_ctes(
    f"SELECT grp, {r('sum(n * pow(m - gm, 2)) / sum(ss)')} AS eta2 FROM (SELECT grp, label, count(*) AS n, avg(v) AS m, "
    f"any_value(gm) AS gm, sum(pow(v - gm, 2)) AS ss FROM (SELECT *, avg(v) OVER (PARTITION BY grp) AS gm FROM first_axis) "
    f"GROUP BY grp, label) GROUP BY grp", "first_axis"))
def _(spark, d):
    return rounded(V.eta2(_first(spark, d), "v", "label", "grp"))


@query("time_r2", with_ctes(f"SELECT grp, {r('pow(corr(v, t), 2)')} AS r2 FROM first_axis GROUP BY grp", "first_axis"))
def _(spark, d):
    return rounded(V.corr2(_first(spark, d), "v", "t", "grp"))


cte("cmean", "SELECT grp, label, pos, avg(v) AS m FROM coord GROUP BY grp, label, pos", "coord")


@query("subspace_overlap", with_ctes(
    f"SELECT a.label AS j, {r('sum(pow(o, 2))')} AS share FROM (SELECT a.label, b.pos % 2 AS h, sum(a.m * {1 / 32 ** 0.5}) AS o "
    f"FROM (SELECT label, pos, avg(v) AS m FROM coord GROUP BY label, pos) a JOIN range(1, 65) b(pos) ON a.pos = b.pos "
    f"GROUP BY a.label, b.pos % 2) a GROUP BY a.label", "coord"))
def _(spark, d):
    means = emb(spark, d).groupBy(F.col("label").alias("j")).agg(A.vec_mean("f").alias("b"))
    basis = spark.createDataFrame([(j, b) for j, b in enumerate(_B)], "j int, b array<double>")
    return rounded(V.overlap(means, basis))


@query("class_mean_subspace_removal")
def _(spark, d):
    basis = S.class_mean_basis(emb(spark, d), "grp", "label")
    return long(V.project_out(emb(spark, d), basis, "grp"), "f")


cte("cen_coord", f"SELECT clip_id, grp, pos, f[pos] AS v FROM cen, range(1, {DIMS + 1}) AS t(pos)", "cen")


@query("subtract_class_means", with_ctes(
    f"SELECT clip_id, CAST(c.pos - 1 AS INT) AS c, {r('c.v - 0.5 * m')} AS v FROM cen_coord c JOIN (SELECT p.clip_id, k.pos, "
    f"sum(p.v * k.m) AS m FROM p JOIN (SELECT p.grp, p.c, x.pos, sum(p.v * x.v) / (sum(p.v) + 1e-9) AS m FROM p JOIN cen_coord x "
    f"USING (clip_id) GROUP BY p.grp, p.c, x.pos) k ON k.grp = p.grp AND k.c = p.c GROUP BY p.clip_id, k.pos) s USING (clip_id, pos)",
    "cen_coord", "p").replace(" AS (", " AS MATERIALIZED ("))
def _(spark, d):
    rows = emb(spark, d).join(probs(spark, d).select("clip_id", "p"), "clip_id")
    return long(V.subtract_class_means(rows, "p", N_CLASSES, "grp", 0.5), "f")


@query("canonical_directions")
def _(spark, d):
    rows = emb(spark, d).withColumns({"a": E("slice(f, 1, 16)"), "b": E("slice(f, 17, 16)")})
    return rounded(S.cca(rows, "a", "b", 4, by="grp").select("grp", "j", "rho"))


cte("shuffled", "SELECT a.clip_id, b.label FROM (SELECT clip_id, grp, row_number() OVER (PARTITION BY grp ORDER BY clip_id) AS n "
                "FROM emb) a JOIN (SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY clip_id) AS n FROM emb) b "
                "USING (grp, n)", "emb")


@query("permute_within_group")
def _(spark, d):
    return V.permute_within(emb(spark, d).select("grp", "clip_id", "label"), "grp", "clip_id", ["label"], 7) \
            .select("clip_id", "label")


@query("permute_within_group_class")
def _(spark, d):
    rows = emb(spark, d).select("grp", "clip_id", "label", F.col("clip_id").alias("donor"))
    return V.permute_within(rows, ["grp", "label"], "clip_id", ["donor"], 7).select("clip_id", "label", "donor")


cte("covars", "SELECT event_id, rec, x, y, unnest([x, y, x * x, x * y, y * y]) AS v, generate_subscripts([1, 2, 3, 4, 5], 1) AS c "
              "FROM ev_rows", "ev_rows")


@query("quadratic_covariates", with_ctes(
    f"SELECT event_id, CAST(c - 1 AS INT) AS c, {r('(v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6)')} AS v FROM covars "
    f"WINDOW w AS (PARTITION BY c)", "covars"))
def _(spark, d):
    rows, _ = V.quadratic(events(spark, d).select("event_id", F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"])
    return long(rows, "x", ("event_id",))


@query("within_clip_share", with_ctes(
    f"SELECT grp, {r('sum(pow(x - m, 2)) / sum(pow(x - gm, 2))')} AS within_share FROM (SELECT grp, x, avg(x) OVER (PARTITION BY grp, rec) "
    f"AS m, avg(x) OVER (PARTITION BY grp) AS gm FROM ev_rows) GROUP BY grp", "ev_rows"))
def _(spark, d):
    return rounded(V.within_share(events(spark, d), "rec", "x", "grp"))


cte("cellc", "SELECT clip_id, grp, label, pos, v - avg(v) OVER (PARTITION BY grp, label, pos) AS v FROM coord", "coord")
cte("cellnorm", "SELECT clip_id, any_value(grp) AS grp, any_value(label) AS label, sqrt(sum(v * v)) AS n FROM cellc GROUP BY clip_id", "cellc")


@query("center_and_scale_cells", with_ctes(
    f"SELECT clip_id, CAST(pos - 1 AS INT) AS c, {r('v * ref.n / (k.n + 1e-8)')} AS v FROM cellc JOIN (SELECT grp, label, avg(n) AS n "
    f"FROM cellnorm GROUP BY grp, label) k USING (grp, label), (SELECT avg(sqrt(list_dot_product(f, f))) AS n FROM emb) ref",
    "cellc", "cellnorm", "emb"))
def _(spark, d):
    return long(V.center_scale_by(emb(spark, d), ["grp", "label"]), "f")


@query("discriminant_basis")
def _(spark, d):
    return S.lda_basis(emb(spark, d), "grp", "label", 3).select("grp", "j", E(f"round({A.norm('b')}, 6)").alias("length"))
