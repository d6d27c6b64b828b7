"""Row filters and column mappings."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.session import keys

E = A.E


def tiles(clips: DataFrame, width: int, start: str = "start") -> DataFrame:
    """Non-overlapping clips."""
    return clips.where(E(f"{start} % {width} = 0"))


def valid_mask(signal: DataFrame, axes: Sequence[str] = ("x", "y", "z"), out: str = "valid") -> DataFrame:
    """True where no sample of any axis array is null, NaN or infinite."""
    fine = " AND ".join(f"forall({a}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < DOUBLE('Infinity'))" for a in axes)
    return signal.withColumn(out, E(fine))


def valid_mask_long(samples: DataFrame, by, axes: Sequence[str] = ("x", "y", "z"), out: str = "valid") -> DataFrame:
    fine = " AND ".join(f"{a} IS NOT NULL AND NOT isnan({a}) AND abs({a}) < DOUBLE('Infinity')" for a in axes)
    return samples.groupBy(*keys(by)).agg(F.bool_and(E(fine)).alias(out))


def assign_sensor(clips: DataFrame, seed: int, n: int, mask: DataFrame | None = None,
                  key: Sequence[str] = ("rec", "start"), draw: str | None = None) -> DataFrame:
    """One sensor per clip by a hash of its key, clips whose drawn sensor is not valid dropped."""
    expr = draw or f"pmod(xxhash64({seed}, {', '.join(key)}), {n})"
    out = clips.withColumn("sensor", E(f"CAST({expr} AS INT)"))
    return out if mask is None else out.join(mask.where("valid"), [*key, "sensor"], "left_semi")


def nan_to_num(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: E(A.clean(c)) for c in columns})


def exclude_ranges(df: DataFrame, ranges: Sequence[tuple], rec: str = "rec", sec: str = "sec") -> DataFrame:
    """Drop (rec, from, to) ranges, ``to`` being None for the rest of the recording. The list is a literal."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    bad = " OR ".join(f"({rec} = {lit(r)} AND {sec} >= {a}" + (f" AND {sec} < {b})" if b is not None else ")")
                      for r, a, b in ranges)
    return df.where(E(f"NOT ({bad})"))


def shift_labels(df: DataFrame, recs: Sequence, shift: int, rec: str = "rec", sec: str = "sec",
                 label: str = "label") -> DataFrame:
    """Take the label of ``shift`` seconds later in the named recordings, the own one where there is none."""
    later = df.where(F.col(rec).isin(list(recs))).select(rec, (F.col(sec) - shift).alias(sec), F.col(label).alias("_l"))
    return df.join(later, [rec, sec], "left").withColumn(label, F.coalesce("_l", label)).drop("_l")


def map_values(df: DataFrame, c: str, mapping: dict, default, out: str) -> DataFrame:
    """Literal dictionary lookup with a default for missing and unknown values."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return df.withColumn(out, E(f"CASE {c} {cases} ELSE {lit(default)} END"))


def one_hot(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    return df.withColumn(out, E(A.one_hot(c, n)))


def coarse_label(name: str) -> str:
    """SQL text: the label up to its first blank or hyphen."""
    return f"split(split({name}, ' ')[0], '-')[0]"


def expand_sensors(clips: DataFrame, n: int, mask: DataFrame | None = None, key: Sequence[str] = ("rec", "start")) -> DataFrame:
    """One row per clip and sensor, valid ones only."""
    out = clips.withColumn("sensor", E(f"explode(sequence(0, {n - 1}))"))
    return out if mask is None else out.join(mask.where("valid"), [*key, "sensor"], "left_semi")


def in_family(df: DataFrame, ids: Sequence[int], label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(list(ids)))


def sample_per_group(df: DataFrame, by, n: int, seed: int, ident: str = "clip_id", draw: str | None = None) -> DataFrame:
    """Up to n rows per group by a hash of the key. The rank limit is applied before the shuffle."""
    order = E(draw) if draw else F.xxhash64(F.lit(seed), F.col(ident))
    w = Window.partitionBy(*keys(by)).orderBy(order, ident)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
