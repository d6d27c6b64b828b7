"""Streams to clips: index windows, majority labels, rate alignment, frame slices, pooling, segments, change series."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.ordered import (CHUNK, chunked, equal_parts, fill_forward_from, running_sum, shifted,
                                         with_row_index)
from clipgraph.session import join_small, keys

E = A.E


def window_starts(idx: str, width: int, stride: int) -> str:
    """SQL text: the starts of all windows that contain a sample index."""
    first = f"CAST(greatest(0, ceil(({idx} - {width} + 1) / {stride})) AS BIGINT) * {stride}"
    last = f"CAST(floor({idx} / {stride}) AS BIGINT) * {stride}"
    return f"IF({last} < {first}, CAST(array() AS ARRAY<BIGINT>), sequence({first}, {last}, CAST({stride} AS BIGINT)))"


def in_windows(samples: DataFrame, width: int, stride: int, idx: str = "idx") -> DataFrame:
    """One copy of each sample per window that contains it, with ``start`` and the position ``pos`` in the window."""
    return samples.withColumn("start", E(f"explode({window_starts(idx, width, stride)})")) \
                  .withColumn("pos", E(f"CAST({idx} - start AS INT)"))


def index_windows(samples: DataFrame, width: int, stride: int, by="rec", idx: str = "idx",
                  label: str | None = "label") -> DataFrame:
    """Complete windows (group, start) with, optionally, the majority label (lowest on ties) and its share."""
    by = keys(by)
    rows = in_windows(samples, width, stride, idx)
    if label is None:
        return rows.groupBy(*by, "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == width).drop("n")
    counts = rows.groupBy(*by, "start", label).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by, "start").agg(
        E(f"max_by({label}, struct(_c, -{label}))").alias("label"),
        (F.max("_c") / F.lit(float(width))).alias("purity"), F.sum("_c").alias("_n")) \
        .where(F.col("_n") == width).drop("_n")


def collect_signal(samples: DataFrame, width: int, stride: int, values: Sequence[str], by="rec",
                   idx: str = "idx") -> DataFrame:
    """Complete windows with one ordered array per value column. Arrays hold ``width`` items."""
    by = keys(by)
    rows = in_windows(samples, width, stride, idx)
    packed = f"array_sort(collect_list(struct(pos, {', '.join(values)})))"
    out = rows.groupBy(*by, "start").agg(E(packed).alias("_x"))
    return out.where(F.size("_x") == width).select(
        *by, "start", *[E(A.each("_x", lambda x, v=v: f"{x}.{v}")).alias(v) for v in values])


def align_rates(clips: DataFrame, frames: DataFrame, sample_rate: int = 50, frame_rate: int = 30, by="rec",
                frame_idx: str = "frame_idx") -> DataFrame:
    """First frame of a clip in a stream of another rate; clips whose second is not fully covered are dropped."""
    by = keys(by)
    length = frames.groupBy(*by).agg((F.max(frame_idx) + 1).alias("_len"))
    return join_small(clips, length, by).withColumn("frame0", E(f"CAST(floor(start * {frame_rate} / {sample_rate}) AS BIGINT)")) \
                .where(E(f"frame0 + {frame_rate} <= _len")).drop("_len")


# fixed values: frames of one second, length of a slice, and the first frame of each slice kind
FRAMES_PER_CLIP = 30
SLICE = 15
OFFSETS = {"head": 0, "center": 7, "tail": 15, "sync": 8}


def frame_slice(clips: DataFrame, frames: DataFrame, offset: str | int, length: int = SLICE, by="rec",
                frame_idx: str = "frame_idx") -> DataFrame:
    """The ``length`` frames of a clip from an offset, the start clipped to the stream: clip rows x (pos, frame).

    The interval is spelled out as frame numbers, so the join is an equi-join on (group, frame).
    """
    by = keys(by)
    off = OFFSETS[offset] if isinstance(offset, str) else offset
    end = frames.groupBy(*by).agg((F.max(frame_idx) + 1).alias("_len"))
    first = f"greatest(0, least(frame0 + {off}, _len - {length}))"
    wanted = join_small(clips, end, by).withColumn("_first", E(first)) \
        .withColumn("pos", E(f"explode(sequence(0, {length - 1}))")) \
        .withColumn(frame_idx, E("_first + pos")).drop("_len", "_first")
    return wanted.join(frames, [*by, frame_idx])


def pool_mean_std(clip_frames: DataFrame, by: Sequence[str], emb: str = "emb") -> DataFrame:
    """mean and population std per dimension, concatenated."""
    from clipgraph.operators.vectors import moments_by

    return moments_by(clip_frames, by, emb).select(*by, F.concat("mean", "std").alias(emb))


def pool(clip_frames: DataFrame, by: Sequence[str], kind: str, emb: str = "emb", pos: str = "pos",
         lo: int = 0, hi: int | None = None) -> DataFrame:
    """mean, mean of unit rows (``unit``), ``ends`` = first, last and mean concatenated; rows lo..hi-1 only."""
    rows = clip_frames.where(f"{pos} >= {lo}" + (f" AND {pos} < {hi}" if hi is not None else ""))
    if kind == "unit":
        return rows.groupBy(*by).agg(A.vec_mean(A.l2_normalize(emb)).alias(emb))
    if kind == "ends":
        g = rows.groupBy(*by).agg(F.min_by(emb, pos).alias("_a"), F.max_by(emb, pos).alias("_b"),
                                  A.vec_mean(emb).alias("_m"))
        return g.select(*by, F.concat("_a", "_b", "_m").alias(emb))
    return rows.groupBy(*by).agg(A.vec_mean(emb).alias(emb))


def segments(df: DataFrame, by, order: Sequence[str], label: str = "label", time: str | None = None,
             max_gap: float | None = None, out: str = "seg", chunk: int = CHUNK) -> DataFrame:
    """Number the runs of equal labels inside a group; with ``max_gap`` a run also ends at a gap in ``time``."""
    by = keys(by)
    rows = with_row_index(df, by, list(order), out="_idx")
    parts, w = chunked(rows, by, "_idx", before=1, chunk=chunk)
    changed = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))
    if max_gap is not None:
        changed = changed | (F.col(time) - F.lag(time).over(w) > F.lit(max_gap))
    flagged = parts.withColumn("_new", F.coalesce(changed, F.lit(True)).cast("int")).where(~F.col("_ghost"))
    return running_sum(flagged.drop("_chunk", "_ghost"), "_new", by, "_idx", out, chunk).drop("_new", "_idx")


def segment_table(df: DataFrame, by, time: str, label: str = "label", seg: str = "seg", min_len: int = 1,
                  skip: int | None = None) -> DataFrame:
    """One row per run: label, length, first and last time."""
    by = keys(by)
    g = df.groupBy(*by, seg).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("n"), F.min(time).alias("t0"),
                                 F.max(time).alias("t1")).where(F.col("n") >= min_len)
    return g if skip is None else g.where(F.col(label) != skip)


def adjacent_segments(seg: DataFrame, by, gap: float) -> DataFrame:
    """Pairs of consecutive runs of a group at most ``gap`` apart."""
    by = keys(by)
    rows = with_row_index(seg, by, ["t0", "seg"], out="_idx")
    for c in ("seg", "label", "t0"):
        rows = shifted(rows, c, -1, by, "_idx", f"next_{c}")
    return rows.where(F.col("next_t0") - F.col("t1") <= gap).drop("_idx")


def split_parts(df: DataFrame, by, order: Sequence[str], parts: int, out: str = "part") -> DataFrame:
    """Near-equal consecutive parts of every group, larger ones first."""
    rows = with_row_index(df, by, list(order), out="_idx", size="_n")
    return rows.withColumn(out, equal_parts(F.col("_idx"), F.col("_n"), parts)).drop("_idx", "_n")


def time_blocks(df: DataFrame, by, order: Sequence[str], blocks: int = 5, out: str = "block") -> DataFrame:
    """floor(i * blocks / n) for the i-th of n rows."""
    rows = with_row_index(df, by, list(order), out="_idx", size="_n")
    return rows.withColumn(out, E(f"CAST(floor(_idx * {blocks} / _n) AS INT)")).drop("_idx", "_n")


def change_series(df: DataFrame, by, sec: str = "sec", f: str = "f") -> DataFrame:
    """1 - cosine between a row and the row one second before; rows without one are dropped."""
    by = keys(by)
    prev = df.select(*by, (F.col(sec) + 1).alias(sec), F.col(f).alias("_prev"))
    return df.join(prev, [*by, sec]).select(*by, sec, E(f"1 - {A.cosine(f, '_prev')}").alias("change"))


def clip_speed(clip_frames: DataFrame, by: Sequence[str], pos: str = "pos", emb: str = "emb") -> DataFrame:
    """Mean 1 - cosine between consecutive frames of a clip."""
    prev = clip_frames.select(*by, (F.col(pos) + 1).alias(pos), F.col(emb).alias("_prev"))
    return clip_frames.join(prev, [*by, pos]).groupBy(*by).agg(F.avg(E(f"1 - {A.cosine(emb, '_prev')}")).alias("speed"))


def device_gravity(qx: str, qy: str, qz: str, qw: str, g: Sequence[str]) -> list[str]:
    """SQL text: a world vector in the device frame of a unit quaternion (the transposed rotation applied to it)."""
    gx, gy, gz = g
    return [
        f"(1 - 2 * ({qy} * {qy} + {qz} * {qz})) * {gx} + 2 * ({qx} * {qy} + {qz} * {qw}) * {gy} "
        f"+ 2 * ({qx} * {qz} - {qy} * {qw}) * {gz}",
        f"2 * ({qx} * {qy} - {qz} * {qw}) * {gx} + (1 - 2 * ({qx} * {qx} + {qz} * {qz})) * {gy} "
        f"+ 2 * ({qy} * {qz} + {qx} * {qw}) * {gz}",
        f"2 * ({qx} * {qz} + {qy} * {qw}) * {gx} + 2 * ({qy} * {qz} - {qx} * {qw}) * {gy} "
        f"+ (1 - 2 * ({qx} * {qx} + {qy} * {qy})) * {gz}",
    ]


def clip_gravity(traj: DataFrame, by: Sequence[str], q: Sequence[str], g: Sequence[str]) -> DataFrame:
    """Mean device-frame gravity per clip."""
    x, y, z = device_gravity(*q, g)
    return traj.groupBy(*by).agg(F.avg(E(x)).alias("gx"), F.avg(E(y)).alias("gy"), F.avg(E(z)).alias("gz"))


def pose_delta(traj: DataFrame, by, q: Sequence[str], t: Sequence[str], idx: str = "idx") -> DataFrame:
    """Rotation angle (degrees) and travelled distance between consecutive poses."""
    by = keys(by)
    cols = [*q, *t]
    parts, w = chunked(traj, by, idx, before=1)
    for c in cols:
        parts = parts.withColumn(f"_p_{c}", F.lag(c).over(w))
    rows = parts.where(f"NOT _ghost AND _p_{cols[0]} IS NOT NULL")
    cosine = " + ".join(f"{c} * _p_{c}" for c in q)
    dist = " + ".join(f"pow({c} - _p_{c}, 2)" for c in t)
    return rows.select(*by, idx, E(f"degrees(2 * acos(least(1D, abs({cosine}))))").alias("angle"),
                       E(f"sqrt({dist})").alias("distance"))


def label_at_shift(df: DataFrame, by, shifts: Sequence[int], sec: str = "sec", label: str = "label") -> DataFrame:
    """The label ``shift`` seconds later, for a literal list of shifts."""
    by = keys(by)
    moved = df.withColumn("shift", E(f"explode(array({', '.join(map(str, shifts))}))")) \
              .withColumn("_at", E(f"{sec} + shift"))
    later = df.select(*by, F.col(sec).alias("_at"), F.col(label).alias("shifted_label"))
    return moved.join(later, [*by, "_at"]).drop("_at")


def asof_forward(left: DataFrame, right: DataFrame, by, left_time: str, right_time: str, payload: Sequence[str],
                 ident: str, chunk: int = CHUNK) -> DataFrame:
    """First right row at or after each left row's time; left rows after the last right row take the last one."""
    by = keys(by)
    fields = [f"{right_time} AS _rt", *payload]
    lhs = left.select(*by, F.col(left_time).alias("_t"), E("1").alias("_side"), F.col(ident).alias("_id"),
                      E("CAST(NULL AS " + right.select(F.struct(*[E(x) for x in fields])).dtypes[0][1] + ")").alias("_r"))
    rhs = right.select(*by, F.col(right_time).alias("_t"), E("2").alias("_side"),
                       E(f"CAST(NULL AS {dict(left.dtypes)[ident]})").alias("_id"),
                       F.struct(*[E(x) for x in fields]).alias("_r"))
    both = with_row_index(lhs.unionByName(rhs), by, ["_t", "_side", "_id"], out="_idx")
    filled = fill_forward_from(both, "_r", by, "_idx", "_next", chunk).where("_side = 1")
    return filled.select(*by, F.col("_id").alias(ident), F.col("_t").alias(left_time),
                         F.col("_next._rt").alias(right_time), *[F.col(f"_next.{p}").alias(p) for p in payload])
