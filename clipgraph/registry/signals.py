"""Sources, filters, windows and clip features."""
from __future__ import annotations


from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import features as X
from clipgraph.operators import filters as FI
from clipgraph.operators import windows as W
from clipgraph.registry.core import (E, LABELS, cte, edges, emb, events, kept, long, query, r, rounded, samples, table, with_ctes)
from clipgraph.registry.scoring import segmented
from clipgraph.session import ensure_checkpoint_dir
from clipgraph.sources import io

WIDTH, STRIDE = 10, 5

cte("win", f"SELECT s.*, w.start, CAST(idx - w.start AS INT) AS pos FROM samples s, LATERAL (SELECT unnest(range(greatest(0, idx - idx % {STRIDE} - {WIDTH}), idx + 1, {STRIDE})) AS start) w "
           f"WHERE idx >= w.start AND idx < w.start + {WIDTH}", "samples")
cte("fullwin", f"SELECT rec, start FROM win GROUP BY rec, start HAVING count(*) = {WIDTH}", "win")
cte("wfull", "SELECT * FROM win JOIN fullwin USING (rec, start)", "win", "fullwin")


def out_dir(spark, name: str) -> str:
    """A fresh folder next to the checkpoints."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---- sources and sinks -------------------------------------------------------------------------------------------

def sample_csv(spark, d):
    """events written as one CSV per group of users, in the layout of sensor recordings."""
    def make():
        path = out_dir(spark, "csv")
        rows = table(spark, d, "events").selectExpr(
            "concat('sbj_', user_id % 5, '_', user_id % 2) AS rec", "event_id", "CAST(value AS FLOAT) AS arm_acc_x",
            "CAST(get_json_object(props, '$.k') AS FLOAT) AS arm_acc_y", "CAST(event_id % 100 AS FLOAT) AS arm_acc_z",
            "IF(event_id % 11 = 0, NULL, event_type) AS label")
        rows.repartition("rec").sortWithinPartitions("rec", "event_id").drop("event_id") \
            .write.partitionBy("rec").option("header", True).csv(path)
        return spark.createDataFrame([(path,)], "path string")
    return kept(spark, d, "csv", make).head()[0]


def read_csv(spark, d):
    from pyspark.sql import types as T

    path = sample_csv(spark, d)
    schema = io.samples_schema(["arm"], ["x", "y", "z"])
    raw = spark.read.schema(schema).option("header", True).csv(path)  # the folder name holds the recording
    labels = {k: v for k, v in LABELS.items() if k != "signup"}  # one label is unknown to the map
    return FI.map_values(raw.withColumn("grp", E(io.participant_of("rec"))), "label", labels, 0, "label")


cte("csvrows", "SELECT concat('sbj_', user_id % 5, '_', user_id % 2) AS rec, CAST(user_id % 5 AS INT) AS grp, value, event_id, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_type = 'click' THEN 1 "
               "WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'error' THEN 4 ELSE 0 END AS label FROM events")


@query("read_sensor_csv", with_ctes(
    "SELECT rec, grp, label, count(*) AS n, (round(avg(CAST(value AS FLOAT)::DOUBLE), 4) + CAST(0 AS DOUBLE)) AS x FROM csvrows GROUP BY ALL", "csvrows"))
def _(spark, d):
    return rounded(read_csv(spark, d).groupBy("rec", "grp", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("arm_acc_x").cast("double")).alias("x")), 4)


@query("sensor_long_rows", with_ctes("SELECT rec, 'arm' AS sensor, count(*) AS n, (round(max(CAST(value AS FLOAT))::DOUBLE, 4) + CAST(0 AS DOUBLE)) AS top FROM csvrows GROUP BY rec", "csvrows"))
def _(spark, d):
    rows = io.sensor_long(read_csv(spark, d), ["arm"], keep=("rec", "label"))
    return rounded(rows.groupBy("rec", "sensor").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")), 4)


@query("recording_key", "SELECT DISTINCT concat('sbj_', user_id, '_2.csv') AS file, concat('sbj_', user_id, '_2') AS rec, CAST(user_id AS INT) AS grp FROM events")
def _(spark, d):
    files = table(spark, d, "events").select(E("concat('sbj_', user_id, '_2.csv')").alias("file")).distinct()
    return io.with_recording_key(files, "file").select("file", "rec", "grp")


@query("read_clip_columns", "SELECT doc_id, lang, n_chars FROM documents")
def _(spark, d):
    return io.read_clips(spark, f"{d}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("read_embeddings", "SELECT vec_id, CAST(u.pos - 1 AS INT) AS c, (round(embedding[u.pos]::DOUBLE, 6) + CAST(0 AS DOUBLE)) AS v FROM embeddings, range(1, 65) AS u(pos)")
def _(spark, d):
    return long(io.read_embeddings(spark, f"{d}/embeddings.parquet", "vec_id", "embedding"), "f", ("vec_id",))


@query("read_trajectory_csv", "SELECT event_id, epoch_us(ts) AS t_us, (round(value, 6) + CAST(0 AS DOUBLE)) AS tx FROM events")
def _(spark, d):
    path = out_dir(spark, "traj")
    events(spark, d).selectExpr("event_id", "us * 1000 + 1 AS t_ns", "x AS tx", "y AS unused").write.option("header", True).csv(path)
    return rounded(io.read_trajectory(spark, path, ["event_id", "tx"], nanos="t_ns").withColumn("event_id", E("CAST(event_id AS BIGINT)")))


@query("write_and_read_predictions", "SELECT doc_id AS id, quality AS target_feature FROM labels")
def _(spark, d):
    path = out_dir(spark, "predictions")
    io.write_predictions(table(spark, d, "labels"), path, "doc_id", "quality")
    return spark.read.schema("id bigint, target_feature int").option("header", True).csv(path)


@query("write_partitioned_table", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    path = out_dir(spark, "clips")
    io.write_table(table(spark, d, "documents").select("doc_id", "lang"), path, ["lang"])
    return spark.read.schema("doc_id bigint, lang string").parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("write_json_summary", "SELECT lang, count(*) AS n, (round(avg(n_chars), 4) + CAST(0 AS DOUBLE)) AS mean FROM documents GROUP BY lang")
def _(spark, d):
    path = out_dir(spark, "summary")
    g = rounded(table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean")), 4)
    io.write_summary(g.select("lang", F.struct("n", "mean").alias("stats")), path)
    return spark.read.schema("lang string, stats struct<n: bigint, mean: double>").json(path).select("lang", "stats.n", "stats.mean")


@query("materialize_once", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    path = out_dir(spark, "stage")
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    io.materialize(g, path)
    return io.materialize(g.where("false"), path)  # the second call reads the first one's output


# ---- filters -----------------------------------------------------------------------------------------------------

@query("tile_filter", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0")
def _(spark, d):
    return FI.tiles(table(spark, d, "orders").select("o_orderkey"), 50, "o_orderkey")


def signals(spark, d):
    return kept(spark, d, "signals", lambda: W.collect_signal(samples(spark, d), WIDTH, STRIDE, ["x", "y", "z"]))


# a value of 0.1 or less in the second axis stands for a sensor failure
BROKEN = "transform(y, v -> IF(v <= 1, DOUBLE('NaN'), IF(v >= 99, DOUBLE('Infinity'), v)))"


@query("validity_mask", with_ctes("SELECT rec, start, min(y) > 1 AND max(y) < 99 AS valid FROM wfull GROUP BY rec, start", "wfull"))
def _(spark, d):
    return FI.valid_mask(signals(spark, d).withColumn("y", E(BROKEN))).select("rec", "start", "valid")


@query("validity_mask_long_rows", with_ctes("SELECT rec, start, min(y) > 1 AND max(y) < 99 AS valid FROM win GROUP BY rec, start", "win"))
def _(spark, d):
    rows = W.in_windows(samples(spark, d), WIDTH, STRIDE).withColumn("y", E("IF(y <= 1, DOUBLE('NaN'), IF(y >= 99, DOUBLE('Infinity'), y))"))
    return FI.valid_mask_long(rows, ["rec", "start"])


def mask(spark, d):
    rows = FI.valid_mask(signals(spark, d).withColumn("y", E(BROKEN))).select("rec", "start", "valid")
    return FI.expand_sensors(rows, 4).withColumn("valid", E("valid OR sensor < 2"))


cte("vmask", "SELECT rec, start, s.s AS sensor, (min(y) > 1 AND max(y) < 99) OR s.s < 2 AS valid FROM wfull, range(4) AS s(s) GROUP BY rec, start, s.s", "wfull")


@query("assign_sensor", with_ctes(
    "SELECT rec, start, CAST(sensor AS INT) AS sensor FROM vmask WHERE valid AND sensor = (rec * 31 + start * 7) % 4", "vmask"))
def _(spark, d):
    clips = signals(spark, d).select("rec", "start")
    return FI.assign_sensor(clips, 1, 4, mask(spark, d), draw="(rec * 31 + start * 7) % 4")


@query("expand_sensors", with_ctes("SELECT rec, start, CAST(sensor AS INT) AS sensor FROM vmask WHERE valid", "vmask"))
def _(spark, d):
    return FI.expand_sensors(signals(spark, d).select("rec", "start"), 4, mask(spark, d))


@query("replace_nan_and_infinity", "SELECT event_id, (round(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 1.7976931348623157e308 WHEN event_id % 5 = 2 THEN -1.7976931348623157e308 "
                                   "ELSE value END, 2) + CAST(0 AS DOUBLE)) AS x FROM events")
def _(spark, d):
    rows = events(spark, d).selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN DOUBLE('NaN') WHEN 1 THEN DOUBLE('Infinity') WHEN 2 THEN DOUBLE('-Infinity') ELSE x END AS x")
    return rounded(FI.nan_to_num(rows, ["x"]), 2)


@query("exclude_ranges", "SELECT event_id FROM events WHERE NOT ((user_id = 3 AND event_id >= 5000) OR (user_id = 8 AND event_id >= 100 AND event_id < 4000))")
def _(spark, d):
    rows = events(spark, d).select("event_id", "rec", F.col("event_id").alias("sec"))
    return FI.exclude_ranges(rows, [(3, 5000, None), (8, 100, 4000)]).select("event_id")


@query("shift_labels", with_ctes("SELECT a.event_id, coalesce(b.label, a.label) AS label FROM samples a LEFT JOIN samples b ON b.rec = a.rec AND b.idx = a.idx + 2 AND a.rec IN (3, 8, 20)", "samples"))
def _(spark, d):
    return FI.shift_labels(samples(spark, d), [3, 8, 20], 2, sec="idx").select("event_id", "label")


@query("one_hot_label", f"SELECT vec_id AS clip_id, CAST(c AS INT) AS c, CASE WHEN label = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, range(10) AS t(c)")
def _(spark, d):
    return long(FI.one_hot(emb(spark, d), "label", 10, "p").select("clip_id", "p"))


@query("map_with_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS label FROM events")
def _(spark, d):
    return FI.map_values(table(spark, d, "events").select("event_id", "event_type"), "event_type", {"click": 1, "view": 2}, 0, "label").select("event_id", "label")


@query("coarse_label", "SELECT o_orderkey, split_part(split_part(o_orderpriority, ' ', 1), '-', 1) AS coarse FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E(FI.coarse_label("o_orderpriority")).alias("coarse"))


@query("class_family", "SELECT vec_id AS clip_id, label FROM embeddings WHERE label IN (1, 3, 5)")
def _(spark, d):
    return FI.in_family(emb(spark, d).select("clip_id", "label"), [1, 3, 5])


@query("mirror_axes", with_ctes(f"SELECT event_id, {r('CASE WHEN sensor = 1 THEN -x ELSE x END')} AS x, {r('y')} AS y, {r('CASE WHEN sensor IN (1, 3) THEN -z ELSE z END')} AS z FROM ev_rows", "ev_rows"))
def _(spark, d):
    out = X.mirror(events(spark, d), {"1": (-1, 1, -1), "3": (1, 1, -1)})
    return rounded(out.select("event_id", "x", "y", "z"))


cte("wmeans", "SELECT rec, start, avg(CASE WHEN sensor < 2 THEN x END) AS lx, avg(CASE WHEN sensor >= 2 THEN x END) AS rx, avg(CASE WHEN sensor < 2 THEN y END) AS ly, avg(CASE WHEN sensor >= 2 THEN y END) AS ry, "
              "avg(CASE WHEN sensor < 2 THEN z END) AS lz, avg(CASE WHEN sensor >= 2 THEN z END) AS rz FROM win GROUP BY rec, start", "win")


@query("choose_mirror_signs", with_ctes(
    f"SELECT CAST(a AS INT) AS sx, CAST(b AS INT) AS sy, CAST(c AS INT) AS sz, {r('avg(sqrt(pow(lx - a * rx, 2) + pow(ly - b * ry, 2) + pow(lz - c * rz, 2)))')} AS dist FROM wmeans, (VALUES (1), (-1)) x(a), (VALUES "
    f"(1), (-1)) y(b), (VALUES (1), (-1)) z(c) WHERE lx IS NOT NULL AND rx IS NOT NULL GROUP BY a, b, c ORDER BY avg(sqrt(pow(lx - a * rx, 2) + pow(ly - b * ry, 2) + pow(lz - c * rz, 2))) LIMIT 1", "wmeans"))
def _(spark, d):
    rows = W.in_windows(samples(spark, d), WIDTH, STRIDE)
    side = lambda c: rows.where(c).groupBy("rec", "start").agg(*[F.avg(a).alias(a) for a in "xyz"])
    return rounded(X.choose_signs(side("sensor < 2"), side("sensor >= 2"), ["rec", "start"]))


# ---- windows -----------------------------------------------------------------------------------------------------

@query("index_windows", with_ctes("SELECT rec, start FROM fullwin", "fullwin"))
def _(spark, d):
    return W.index_windows(samples(spark, d), WIDTH, STRIDE, label=None)


@query("window_majority_label", with_ctes(
    f"SELECT rec, start, arg_max(label, struct_pack(n := n, l := -label)) AS label, {r('max(n) / 10.0')} AS purity FROM (SELECT rec, start, label, count(*) AS n FROM wfull GROUP BY ALL) GROUP BY rec, start", "wfull"))
def _(spark, d):
    return rounded(W.index_windows(samples(spark, d), WIDTH, STRIDE))


@query("collect_signal", with_ctes("SELECT rec, start, pos, x, y FROM wfull", "wfull"))
def _(spark, d):
    s = signals(spark, d).select("rec", "start", E("posexplode(arrays_zip(x, y))").alias("pos", "s"))
    return s.select("rec", "start", "pos", "s.x", "s.y")


def clip_starts(spark, d):
    return W.index_windows(samples(spark, d), WIDTH, STRIDE, label=None)


def frames(spark, d):
    """Three frames per five samples: every position but those at offsets 1 and 3 of five."""
    return samples(spark, d).where("idx % 5 NOT IN (1, 3)").selectExpr("rec", "(idx DIV 5) * 3 + CASE idx % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS frame_idx", "array(x, y, z) AS emb")


cte("frm", "SELECT rec, (idx // 5) * 3 + CASE idx % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS fi, x, y, z FROM samples WHERE idx % 5 NOT IN (1, 3)", "samples")
cte("flen", "SELECT rec, max(fi) + 1 AS n FROM frm GROUP BY rec", "frm")
cte("aligned", "SELECT rec, start, CAST(floor(start * 6 / 10) AS BIGINT) AS frame0 FROM fullwin JOIN flen USING (rec) WHERE floor(start * 6 / 10) + 6 <= n", "fullwin", "flen")


def aligned(spark, d):
    return kept(spark, d, "aligned", lambda: W.align_rates(clip_starts(spark, d), frames(spark, d), 10, 6))


@query("align_rates", with_ctes("SELECT rec, start, frame0 FROM aligned", "aligned"))
def _(spark, d):
    return aligned(spark, d)


cte("sliced", "SELECT a.rec, a.start, f.fi - least(greatest(0, least(a.frame0 + 2, n - 3)), n) AS pos, x, y, z FROM aligned a JOIN flen USING (rec) JOIN frm f ON f.rec = a.rec AND f.fi BETWEEN greatest(0, "
              "least(a.frame0 + 2, n - 3)) AND greatest(0, least(a.frame0 + 2, n - 3)) + 2", "aligned", "flen", "frm")


def sliced(spark, d):
    return kept(spark, d, "sliced", lambda: W.frame_slice(aligned(spark, d), frames(spark, d), 2, 3))


@query("frame_slice", with_ctes("SELECT rec, start, CAST(pos AS INT) AS pos, x FROM sliced", "sliced"))
def _(spark, d):
    return sliced(spark, d).select("rec", "start", "pos", E("emb[0]").alias("x"))


@query("pool_mean_std", with_ctes(
    f"SELECT rec, start, {r('avg(x)')} AS mx, {r('avg(z)')} AS mz, {r('stddev_pop(x)', 5)} AS sx, {r('stddev_pop(z)', 5)} AS sz FROM sliced GROUP BY rec, start", "sliced"))
def _(spark, d):
    p = W.pool_mean_std(sliced(spark, d), ["rec", "start"])
    return p.select("rec", "start", *[F.round(E(f"emb[{i}]"), n).alias(c) for i, c, n in ((0, "mx", 6), (2, "mz", 6), (3, "sx", 5), (5, "sz", 5))])


@query("pool_unit_mean", with_ctes(
    f"SELECT rec, start, {r('avg(x / (sqrt(x * x + y * y + z * z) + 1e-8))')} AS ux FROM sliced GROUP BY rec, start", "sliced"))
def _(spark, d):
    return rounded(W.pool(sliced(spark, d), ["rec", "start"], "unit").select("rec", "start", E("emb[0]").alias("ux")))


@query("pool_ends_and_mean", with_ctes(f"SELECT rec, start, {r('arg_min(x, pos)')} AS a, {r('arg_max(x, pos)')} AS b, {r('avg(x)')} AS m FROM sliced GROUP BY rec, start", "sliced"))
def _(spark, d):
    p = W.pool(sliced(spark, d), ["rec", "start"], "ends")
    return rounded(p.select("rec", "start", E("emb[0]").alias("a"), E("emb[3]").alias("b"), E("emb[6]").alias("m")))


@query("pool_sub_range", with_ctes(f"SELECT rec, start, {r('avg(y)')} AS y FROM sliced WHERE pos >= 1 AND pos < 3 GROUP BY rec, start", "sliced"))
def _(spark, d):
    return rounded(W.pool(sliced(spark, d), ["rec", "start"], "mean", lo=1, hi=3).select("rec", "start", E("emb[1]").alias("y")))


@query("label_segments", with_ctes("SELECT event_id, CAST(seg AS BIGINT) AS seg FROM segs", "segs"))
def _(spark, d):
    return segmented(spark, d).select("event_id", "seg")


cte("gapsegs", "SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY idx) AS seg FROM (SELECT *, CASE WHEN lag(label) OVER w = label AND us - lag(us) OVER w <= 36000000000 THEN 0 ELSE 1 END AS new FROM samples WINDOW "
               "w AS (PARTITION BY rec ORDER BY idx))", "samples")
cte("segtab", "SELECT rec, seg, min(label) AS label, count(*) AS n, min(us) AS t0, max(us) AS t1 FROM gapsegs GROUP BY rec, seg", "gapsegs")


def gap_segments(spark, d):
    return kept(spark, d, "gapsegs", lambda: W.segments(samples(spark, d), "rec", ["us", "event_id"], time="us", max_gap=36000000000, chunk=32))


@query("gap_segments", with_ctes("SELECT rec, CAST(seg AS BIGINT) AS seg, label, n, t0, t1 FROM segtab WHERE n >= 2 AND label <> 0", "segtab"))
def _(spark, d):
    return W.segment_table(gap_segments(spark, d), "rec", "us", min_len=2, skip=0)


@query("adjacent_segments", with_ctes(
    "SELECT rec, CAST(seg AS BIGINT) AS seg, CAST(next_seg AS BIGINT) AS next_seg, label, next_label FROM (SELECT *, lead(seg) OVER w AS next_seg, lead(label) OVER w AS next_label, lead(t0) OVER w AS next_t0 FROM segtab "
    "WINDOW w AS (PARTITION BY rec ORDER BY t0, seg)) WHERE next_t0 - t1 <= 7200000000", "segtab"))
def _(spark, d):
    seg = W.segment_table(gap_segments(spark, d), "rec", "us")
    return W.adjacent_segments(seg, "rec", 7200000000).select("rec", "seg", "next_seg", "label", "next_label")


@query("split_parts", with_ctes("SELECT event_id, CAST(ntile(4) OVER (PARTITION BY rec ORDER BY idx) - 1 AS INT) AS part FROM samples", "samples"))
def _(spark, d):
    return W.split_parts(events(spark, d), "rec", ["us", "event_id"], 4).select("event_id", "part")


@query("time_blocks", with_ctes("SELECT event_id, CAST(floor(idx * 5 / count(*) OVER (PARTITION BY rec)) AS INT) AS block FROM samples", "samples"))
def _(spark, d):
    return W.time_blocks(events(spark, d), "rec", ["us", "event_id"]).select("event_id", "block")


_cos = "1 - ({a}x * {b}x + {a}y * {b}y + {a}z * {b}z) / (sqrt({a}x * {a}x + {a}y * {a}y + {a}z * {a}z) * sqrt({b}x * {b}x + {b}y * {b}y + {b}z * {b}z))"


@query("change_series", with_ctes(f"SELECT a.rec, a.idx AS sec, {r(_cos.format(a='a.', b='b.'))} AS change FROM samples a JOIN samples b ON a.rec = b.rec AND b.idx = a.idx - 1 WHERE (a.x <> 0 OR a.y <> 0) AND "
                                  f"(b.x <> 0 OR b.y <> 0) UNION ALL SELECT a.rec, a.idx, NULL FROM samples a JOIN samples b ON a.rec = b.rec AND b.idx = a.idx - 1 WHERE NOT ((a.x <> 0 OR a.y <> 0) AND (b.x <> 0 OR "
                                  f"b.y <> 0))", "samples"))
def _(spark, d):
    rows = samples(spark, d).selectExpr("rec", "idx AS sec", "array(x, y, z) AS f")
    return rounded(W.change_series(rows, "rec"))


@query("clip_speed", with_ctes(
    f"SELECT a.rec, a.start, {r('avg(' + _cos.format(a='a.', b='b.') + ')')} AS speed FROM sliced a JOIN sliced b ON a.rec = b.rec AND a.start = b.start AND b.pos = a.pos - 1 GROUP BY a.rec, a.start", "sliced"))
def _(spark, d):
    return rounded(W.clip_speed(sliced(spark, d), ["rec", "start"]))


# unit quaternions from three values
cte("traj", "SELECT event_id, rec, idx, x / n AS qx, y / n AS qy, z / n AS qz, 1 / n AS qw, x AS tx, y AS ty, z AS tz FROM (SELECT *, sqrt(x * x + y * y + z * z + 1) AS n FROM samples)", "samples")


def traj(spark, d):
    return samples(spark, d).withColumn("n", E("sqrt(x * x + y * y + z * z + 1)")).selectExpr(
        "event_id", "rec", "idx", "x / n AS qx", "y / n AS qy", "z / n AS qz", "1 / n AS qw", "x AS tx", "y AS ty", "z AS tz")


@query("device_gravity", with_ctes(
    f"SELECT rec, {r('avg(2 * (qx * qz - qy * qw) * -9.81)')} AS gx, {r('avg(2 * (qy * qz + qx * qw) * -9.81)')} AS gy, {r('avg((1 - 2 * (qx * qx + qy * qy)) * -9.81)')} AS gz FROM traj GROUP BY rec", "traj"))
def _(spark, d):
    rows = traj(spark, d).selectExpr("*", "0D AS g0", "0D AS g1", "-9.81D AS g2")
    return rounded(W.clip_gravity(rows, ["rec"], ["qx", "qy", "qz", "qw"], ["g0", "g1", "g2"]))


@query("pose_delta", with_ctes(
    f"SELECT a.rec, a.idx, {r('degrees(2 * acos(least(1, abs(a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw))))', 3)} AS angle, {r('sqrt(pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) + pow(a.tz - b.tz, 2))')} AS "
    f"distance FROM traj a JOIN traj b ON a.rec = b.rec AND b.idx = a.idx - 1", "traj"))
def _(spark, d):
    out = W.pose_delta(traj(spark, d), "rec", ["qx", "qy", "qz", "qw"], ["tx", "ty", "tz"])
    return out.select("rec", "idx", F.round("angle", 3).alias("angle"), F.round("distance", 6).alias("distance"))


@query("label_at_shift", with_ctes("SELECT a.event_id, s.s AS shift, b.label AS shifted_label FROM samples a, (VALUES (-2), (0), (3)) AS s(s) JOIN samples b ON b.rec = a.rec AND b.idx = a.idx + s.s", "samples"))
def _(spark, d):
    return W.label_at_shift(samples(spark, d), "rec", [-2, 0, 3], "idx").select("event_id", "shift", "shifted_label")


@query("asof_forward", with_ctes(
    "SELECT l.event_id, coalesce(r.us, m.us) AS right_us, coalesce(r.x, m.x) AS x FROM (SELECT * FROM samples WHERE label = 1) l ASOF LEFT JOIN (SELECT * FROM samples WHERE label = 2) r ON l.rec = r.rec AND l.us <= r.us LEFT "
    "JOIN (SELECT rec, max(us) AS us, arg_max(x, us) AS x FROM samples WHERE label = 2 GROUP BY rec) m ON m.rec = l.rec", "samples"))
def _(spark, d):
    s = samples(spark, d)
    left, right = s.where("label = 1").select("rec", "event_id", "us"), s.where("label = 2").select("rec", F.col("us").alias("right_us"), "x")
    return W.asof_forward(left, right, "rec", "us", "right_us", ["x"], "event_id", chunk=16).select("event_id", "right_us", "x")


# ---- features ----------------------------------------------------------------------------------------------------

cte("wl", "SELECT *, sqrt(x * x + y * y + z * z) AS m FROM wfull", "wfull")
cte("wc", "SELECT *, " + ", ".join(f"{a} - lag({a}) OVER o AS d{a}, {a} - avg({a}) OVER g AS c{a}" for a in "xyzm")
    + " FROM wl WINDOW o AS (PARTITION BY rec, start ORDER BY pos), g AS (PARTITION BY rec, start)", "wl")
cte("wz", "SELECT *, " + ", ".join(f"CASE WHEN lag(sign(c{a})) OVER o IS NULL THEN NULL ELSE CAST(sign(c{a}) <> lag(sign(c{a})) OVER o AS INT) END AS z{a}" for a in "xyzm")
    + " FROM wc WINDOW o AS (PARTITION BY rec, start ORDER BY pos)", "wc")


def _stats(a: str) -> dict[str, str]:
    sd = f"(sqrt(avg(c{a} * c{a})) + 1e-6)"
    return {f"mean_{a}": f"avg({a})", f"std_{a}": f"sqrt(avg(c{a} * c{a}))", f"min_{a}": f"min({a})", f"max_{a}": f"max({a})", f"med_{a}": f"quantile_cont({a}, 0.5)", f"q25_{a}": f"quantile_cont({a}, 0.25)",
            f"q75_{a}": f"quantile_cont({a}, 0.75)", f"absdiff_{a}": f"avg(abs(d{a}))", f"diffstd_{a}": f"stddev_pop(d{a})", f"rms_{a}": f"sqrt(avg({a} * {a}))", f"ptp_{a}": f"max({a}) - min({a})",
            f"skew_{a}": f"avg(c{a} * c{a} * c{a}) / pow({sd}, 3)", f"kurt_{a}": f"avg(c{a} * c{a} * c{a} * c{a}) / pow({sd}, 4)", f"zcr_{a}": f"avg(z{a})"}


def _corr(a: str, b: str) -> str:
    return f"avg(c{a} * c{b}) / (sqrt(avg(c{a} * c{a})) * sqrt(avg(c{b} * c{b})) + 1e-6)"


MAG = {"mag_mean": "avg(m)", "mag_std": "stddev_pop(m)", "mag_min": "min(m)", "mag_max": "max(m)", "mag_ptp": "max(m) - min(m)", "mag_absdiff": "avg(abs(dm))", "mag_energy": "avg(m * m)"}
ROOTS = {k: v for k, v in MAG.items() if k != "mag_energy"}  # the energy has its own query, with fewer digits
CORR = {f"corr_{a}{b}": _corr(a, b) for a, b in ("xy", "xz", "yz")}
STATS = {k: v for a in "xyz" for k, v in _stats(a).items()}
PI2 = 2 * 3.141592653589793


def feature_rows(spark, d):
    s = W.in_windows(samples(spark, d), WIDTH, STRIDE)
    return s.join(clip_starts(spark, d), ["rec", "start"], "left_semi")


def features(spark, d):
    return kept(spark, d, "features", lambda: X.clip_features(feature_rows(spark, d), ["rec", "start"], WIDTH, bands=((0, 1), (1, 3), (3, 5))))


def feature_query(name: str, exprs: dict[str, str], digits: int = 5) -> None:
    cols = ", ".join(f"{r(v, digits)} AS {k}" for k, v in exprs.items())

    @query(name, with_ctes(f"SELECT rec, start, {cols} FROM wz GROUP BY rec, start", "wz"))
    def _(spark, d):
        return rounded(features(spark, d).select("rec", "start", *exprs), digits)


pick = lambda *n: {f"{k}_{a}": STATS[f"{k}_{a}"] for k in n for a in "xyz"}
feature_query("feature_moments", pick("mean", "std", "min", "max"))
# quantiles of values with four decimals are exact decimals: eight digits keep them clear of rounding ties
feature_query("feature_quantiles", pick("med", "q25", "q75"), 8)
feature_query("feature_differences", pick("absdiff", "diffstd"))
feature_query("feature_rms_and_range", pick("rms", "ptp"))
feature_query("feature_skew_kurtosis", pick("skew", "kurt"))
feature_query("feature_zero_crossings", pick("zcr"))
feature_query("feature_magnitude", MAG, 4)
feature_query("feature_axis_correlation", CORR)


def spec_cte(a: str) -> None:
    cte(f"spec{a}", f"SELECT rec, start, k, pow(sum(c{a} * cos({PI2} * k * pos / {WIDTH})), 2) + pow(sum(c{a} * sin({PI2} * k * pos / {WIDTH})), 2) AS p FROM wc, range(1, {WIDTH // 2 + 1}) AS t(k) GROUP BY rec, start, k", "wc")


for _a in "xyzm":
    spec_cte(_a)


@query("power_spectrum", with_ctes(f"SELECT rec, start, CAST(k AS INT) AS bin, {r('p')} AS power FROM specx", "specx"))
def _(spark, d):
    return rounded(X.power_spectrum(feature_rows(spark, d), ["rec", "start"], "x", WIDTH))


def spectral_sql(a: str) -> str:
    t = "(sum(p) + 1e-8)"
    return (f"SELECT rec, start, arg_max(k, struct_pack(p := round(p, 6), n := -k))::DOUBLE AS domfreq_{a}, {r(f'max(p) / {t}')} AS dompow_{a}, {r(f'sum(p * k) / {t}')} AS centroid_{a}, "
            f"{r('sum(e)')} AS specent_{a}, {r(f'sum(p) FILTER (k <= 1) / {t}')} AS band0_1_{a}, {r(f'sum(p) FILTER (k > 1 AND k <= 3) / {t}')} AS band1_3_{a}, {r(f'sum(p) FILTER (k > 3) / {t}')} AS band3_5_{a} "
            f"FROM (SELECT *, -(p / tt * ln(p / tt + 1e-12)) AS e FROM (SELECT *, sum(p) OVER (PARTITION BY rec, start) + 1e-8 AS tt FROM spec{a})) GROUP BY rec, start")


@query("feature_spectrum", with_ctes(spectral_sql("x"), "specx"))
def _(spark, d):
    return rounded(features(spark, d).select("rec", "start", *[f"{n}_x" for n in ("domfreq", "dompow", "centroid", "specent", "band0_1", "band1_3", "band3_5")]))


@query("feature_spectrum_other_axis", with_ctes(spectral_sql("y"), "specy"))
def _(spark, d):
    return rounded(features(spark, d).select("rec", "start", *[f"{n}_y" for n in ("domfreq", "dompow", "centroid", "specent", "band0_1", "band1_3", "band3_5")]))


@query("feature_magnitude_spectrum", with_ctes(
    f"SELECT rec, start, arg_max(k, struct_pack(p := round(p, 6), n := -k))::DOUBLE AS mag_domfreq, {r('max(p) / (sum(p) + 1e-8)')} AS mag_dompow FROM specm GROUP BY rec, start", "specm"))
def _(spark, d):
    return rounded(features(spark, d).select("rec", "start", "mag_domfreq", "mag_dompow"))


@query("static_and_dynamic_features", with_ctes(
    f"SELECT rec, start, {r('avg(x)', 5)} AS static_x, {r('stddev_pop(x)', 5)} AS std_x, {r('max(x) - min(x)', 5)} AS ptp_x, {r('avg(abs(dx))', 5)} AS absdiff_x FROM wz GROUP BY rec, start", "wz"))
def _(spark, d):
    return rounded(X.static_dynamic(feature_rows(spark, d), ["rec", "start"], ["x"]), 5)


@query("all_clip_features", with_ctes(
    "SELECT rec, start, " + ", ".join(f"{r(v)} AS {k}" for k, v in {**STATS, **ROOTS, **CORR}.items()) + " FROM wz GROUP BY rec, start", "wz"))
def _(spark, d):
    return rounded(features(spark, d).select("rec", "start", *STATS, *ROOTS, *CORR))
