"""Registered queries and their SQL equivalents, and the logical tables both start from.

Every query works on the whole driver tables: ``samples`` come from events (recording = user), clip embeddings from
embeddings (five groups by id), class probabilities from the labelled neighbours in other groups.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import knn as K
from clipgraph.operators.ordered import with_row_index
from clipgraph.session import cut

E = A.E
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

N_CLASSES = 10
DIMS = 64
KNN = 10
LABELS = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def table_stream(spark: SparkSession, d: str, name: str, schema: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them: a stream takes both from a pattern."""
    return spark.readStream.schema(schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A logical table several queries start from: checkpointed once per session and folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = cut(make())
    return _kept[key]


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr(
        "vec_id AS clip_id", "vec_id % 5 AS grp", "label", f"{A.to_double('embedding')} AS f")


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id AS clip_id", "label")


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def events(spark: SparkSession, d: str) -> DataFrame:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items())
    return table(spark, d, "events").selectExpr(
        "event_id", "user_id AS rec", "user_id % 7 AS grp", f"CASE event_type {cases} END AS label",
        f"{MICROS} AS us", f"CAST(floor({MICROS} / 3600000000) AS BIGINT) AS hour", "event_id % 4 AS sensor",
        "value AS x", "CAST(get_json_object(props, '$.k') AS DOUBLE) AS y",
        "value * CAST(get_json_object(props, '$.k') AS DOUBLE) / 100 AS z")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """events with the position in the user's stream."""
    return kept(spark, d, "samples", lambda: with_row_index(events(spark, d), "rec", ["us", "event_id"], out="idx"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "edges", lambda: K.knn(emb(spark, d), "grp", KNN))


def weights(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "weights", lambda: K.edge_weights(edges(spark, d)))


def cross(spark: SparkSession, d: str) -> DataFrame:
    """The nearest rows of other groups, which both probability tables start from."""
    return kept(spark, d, "cross", lambda: K.cross_group_knn(emb(spark, d), emb(spark, d), KNN).select("src", "dst", "sim", "rank"))


def probs(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "probs", lambda: K.anchor_prior(emb(spark, d), emb(spark, d), N_CLASSES, KNN, edges=cross(spark, d)))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """A second, differently shaped probability table: three neighbours, sharper."""
    return kept(spark, d, "evidence", lambda: K.anchor_prior(emb(spark, d), emb(spark, d), N_CLASSES, 3, 20.0, smooth=1e-3, edges=cross(spark, d)))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the decisions of both tables and a group."""
    p = probs(spark, d).select("grp", "clip_id", "p", E(A.argmax("p")).alias("pred"))
    v = evidence(spark, d).select("clip_id", E(A.argmax("p")).alias("base_pred"))
    return p.join(v, "clip_id").join(labels_of(spark, d), "clip_id")


def long(df: DataFrame, p: str = "p", keep: tuple[str, ...] = ("clip_id",), digits: int = 6) -> DataFrame:
    """(keys, c, v) with rounded values."""
    return df.select(*keep, E(f"posexplode({p})").alias("c", "v")).select(*keep, "c", F.round("v", digits).alias("v"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ---- SQL side ----------------------------------------------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(select: str, *needs: str) -> str:
    """``select`` after the definitions it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in CTES[n][0]:
                visit(m)
            order.append(n)
    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


cte("emb", "SELECT vec_id AS clip_id, vec_id % 5 AS grp, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings")
cte("coord", f"SELECT clip_id, grp, label, pos, f[pos] AS v FROM emb, range(1, {DIMS + 1}) AS t(pos)", "emb")
cte("cen", "SELECT clip_id, grp, list(v - m ORDER BY pos) AS f FROM "
           "(SELECT *, avg(v) OVER (PARTITION BY grp, pos) AS m FROM coord) GROUP BY clip_id, grp", "coord")
cte("unit", "SELECT clip_id, grp, list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8)) AS f FROM cen", "cen")
cte("rawunit", "SELECT clip_id, grp, label, list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8)) AS f "
               "FROM emb", "emb")
cte("pairs", "SELECT a.grp, a.clip_id AS src, b.clip_id AS dst, list_dot_product(a.f, b.f) AS sim "
             "FROM unit a JOIN unit b ON a.grp = b.grp AND a.clip_id <> b.clip_id", "unit")


def edge_ctes(prefix: str, pairs: str, k: int = KNN, sharp: float = 10.0) -> None:
    """<prefix>knn, <prefix>edges (with mutual) and <prefix>w over a (grp, src, dst, sim) relation."""
    cte(f"{prefix}knn", f"SELECT * FROM (SELECT grp, src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) "
                        f"AS rank FROM {pairs}) WHERE rank <= {k}", pairs)
    cte(f"{prefix}edges", f"SELECT e.*, r.src IS NOT NULL AS mutual FROM {prefix}knn e LEFT JOIN {prefix}knn r "
                          f"ON e.src = r.dst AND e.dst = r.src", f"{prefix}knn")
    cte(f"{prefix}raw", f"SELECT grp, src, dst, CASE WHEN best IS NULL THEN 1.0 WHEN mutual THEN exp({sharp} * (sim - best)) END AS w "
                        f"FROM (SELECT *, max(CASE WHEN mutual THEN sim END) OVER (PARTITION BY src) AS best FROM {prefix}edges)",
        f"{prefix}edges")
    cte(f"{prefix}w", f"SELECT grp, src, dst, w / (sum(w) OVER (PARTITION BY src) + 1e-12) AS w FROM {prefix}raw WHERE w IS NOT NULL",
        f"{prefix}raw")


edge_ctes("", "pairs")
cte("anchorpairs", "SELECT a.grp, a.clip_id AS src, b.clip_id AS dst, b.label AS y, b.grp AS bgrp, "
                   "list_dot_product(a.f, b.f) AS sim FROM rawunit a JOIN rawunit b ON a.grp <> b.grp", "rawunit")
cte("anchorrank", "SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM anchorpairs", "anchorpairs")


def anchor_ctes(name: str, k: int, temp: float, smooth: float) -> None:
    cte(f"{name}_top", f"SELECT *, exp({temp} * (sim - max(sim) OVER (PARTITION BY src))) AS w FROM anchorrank WHERE rank <= {k}",
        "anchorrank")
    cte(name, f"SELECT grp, clip_id, c, v / sum(v) OVER (PARTITION BY clip_id) AS v FROM (SELECT e.grp, e.clip_id, c.c, "
              f"coalesce(sum(t.w), 0) + {smooth} AS v FROM emb e CROSS JOIN range({N_CLASSES}) AS c(c) "
              f"LEFT JOIN {name}_top t ON t.src = e.clip_id AND t.y = c.c GROUP BY e.grp, e.clip_id, c.c)", "emb", f"{name}_top")


anchor_ctes("p", KNN, 10.0, 1e-6)
anchor_ctes("ev", 3, 20.0, 1e-3)
cte("pred", "SELECT e.clip_id, e.grp, e.label, CAST(p.pred AS INT) AS pred, CAST(q.pred AS INT) AS base_pred FROM emb e JOIN "
            "(SELECT clip_id, arg_max(c, struct_pack(v := v, n := -c)) AS pred FROM p GROUP BY clip_id) p USING (clip_id) JOIN "
            "(SELECT clip_id, arg_max(c, struct_pack(v := v, n := -c)) AS pred FROM ev GROUP BY clip_id) q USING (clip_id)",
    "emb", "p", "ev")
_cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items())
cte("ev_rows", f"SELECT event_id, user_id AS rec, user_id % 7 AS grp, CASE event_type {_cases} END AS label, epoch_us(ts) AS us, "
               "CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_id % 4 AS sensor, value AS x, "
               "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, "
               "value * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS z FROM events")
cte("samples", "SELECT *, row_number() OVER (PARTITION BY rec ORDER BY us, event_id) - 1 AS idx FROM ev_rows", "ev_rows")


def step_ctes(prefix: str, w: str, base: str, iters: int, alpha: float) -> str:
    """<prefix>1..iters: propagation steps from ``base`` over the edges ``w``. Returns the last name."""
    prev = base
    for i in range(1, iters + 1):
        cte(f"{prefix}{i}", f"SELECT b.grp, b.clip_id, b.c, (1 - {alpha}) * b.v + {alpha} * coalesce(a.v, 0) AS v FROM {base} b "
                            f"LEFT JOIN (SELECT e.src, q.c, sum(e.w * q.v) AS v FROM {w} e JOIN {prev} q ON q.clip_id = e.dst "
                            f"GROUP BY e.src, q.c) a ON a.src = b.clip_id AND a.c = b.c", w, base, prev)
        prev = f"{prefix}{i}"
    return prev


def sharpen_cte(name: str, q: str, temp: float) -> None:
    cte(name, f"SELECT grp, clip_id, c, pow(greatest(v, 1e-9), {temp}) / sum(pow(greatest(v, 1e-9), {temp})) OVER "
              f"(PARTITION BY clip_id) AS v FROM {q}", q)


def pool_cte(name: str, q: str, v: str, g: float) -> None:
    cte(name, f"SELECT grp, clip_id, c, x / sum(x) OVER (PARTITION BY clip_id) AS v FROM (SELECT q.grp, q.clip_id, q.c, "
              f"exp((1 - {g}) * ln(greatest(q.v, 1e-9)) + {g} * ln(greatest(o.v, 1e-9))) AS x FROM {q} q JOIN {v} o "
              f"ON o.clip_id = q.clip_id AND o.c = q.c)", q, v)


def rebuild_ctes(prefix: str, q: str, lam: float, k: int = KNN) -> str:
    """Edges of the graph on [unit, lam * sqrt(q)]: returns the weight relation."""
    cte(f"{prefix}norm", f"SELECT q.clip_id, sqrt(any_value(list_dot_product(u.f, u.f)) + {lam * lam} * sum(q.v)) + 1e-8 AS n "
                         f"FROM {q} q JOIN unit u USING (clip_id) GROUP BY q.clip_id", q, "unit")
    cte(f"{prefix}bhat", f"SELECT x.clip_id AS src, y.clip_id AS dst, sum(sqrt(x.v * y.v)) AS b FROM {q} x JOIN {q} y "
                         f"ON x.grp = y.grp AND x.c = y.c AND x.clip_id <> y.clip_id GROUP BY 1, 2", q)
    cte(f"{prefix}pairs", f"SELECT s.grp, s.src, s.dst, (s.sim + {lam * lam} * b.b) / (na.n * nb.n) AS sim FROM pairs s "
                          f"JOIN {prefix}norm na ON na.clip_id = s.src JOIN {prefix}norm nb ON nb.clip_id = s.dst "
                          f"JOIN {prefix}bhat b ON b.src = s.src AND b.dst = s.dst", "pairs", f"{prefix}norm", f"{prefix}bhat")
    edge_ctes(prefix, f"{prefix}pairs", k)
    return f"{prefix}w"
