"""Clip features from long sample rows (clip keys, pos, x, y, z), every clip being one bounded window.

One shuffle by the clip key serves the lag and both aggregations; spectra are sums against cosine and sine waves in the
same pass, since bins 1.. of a transform do not depend on the mean.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.session import keys

E = A.E
AXES = ("x", "y", "z")
BANDS = ((0, 3), (3, 6), (6, 12), (12, 25))


def _prepared(samples: DataFrame, by: list[str], axes: Sequence[str], pos: str, magnitude: bool) -> DataFrame:
    """Add the magnitude, the lags and the clip means. All windows share one partitioning and sort."""
    rows = samples
    names = list(axes)
    if magnitude:
        rows = rows.withColumn("m", E("sqrt(" + " + ".join(f"{a} * {a}" for a in axes) + ")"))
        names.append("m")
    order = Window.partitionBy(*by).orderBy(pos)
    whole = Window.partitionBy(*by)
    # one pass per window kind: lags, means, then the lagged signs
    rows = rows.withColumns({**{f"_d_{a}": F.col(a) - F.lag(a).over(order) for a in names},
                             **{f"_mu_{a}": F.avg(a).over(whole) for a in names}})
    rows = rows.withColumns({f"_sg_{a}": E(f"signum({a} - _mu_{a})") for a in names})
    return rows.withColumns({f"_z_{a}": (F.col(f"_sg_{a}") != F.lag(f"_sg_{a}").over(order)).cast("int") for a in names})


def _moments(a: str) -> dict[str, str]:
    c = f"({a} - _mu_{a})"
    return {
        f"mean_{a}": f"avg({a})", f"std_{a}": f"sqrt(avg({c} * {c}))", f"min_{a}": f"min({a})", f"max_{a}": f"max({a})",
        # one value table per clip and axis for the three quantiles; a clip holds ``width`` values
        f"_q_{a}": f"percentile({a}, array(0.25D, 0.5D, 0.75D))", f"absdiff_{a}": f"avg(abs(_d_{a}))",
        f"diffstd_{a}": f"stddev_pop(_d_{a})", f"rms_{a}": f"sqrt(avg({a} * {a}))", f"ptp_{a}": f"max({a}) - min({a})",
        f"skew_{a}": f"avg({c} * {c} * {c}) / pow(sqrt(avg({c} * {c})) + 1e-6D, 3)",
        f"kurt_{a}": f"avg({c} * {c} * {c} * {c}) / pow(sqrt(avg({c} * {c})) + 1e-6D, 4)",
        f"zcr_{a}": f"avg(_z_{a})",
    }


def _magnitude() -> dict[str, str]:
    return {"mag_mean": "avg(m)", "mag_std": "stddev_pop(m)", "mag_min": "min(m)", "mag_max": "max(m)",
            "mag_ptp": "max(m) - min(m)", "mag_absdiff": "avg(abs(_d_m))", "mag_energy": "avg(m * m)"}


def _correlations(axes: Sequence[str]) -> dict[str, str]:
    out = {}
    for i, a in enumerate(axes):
        for b in axes[i + 1:]:
            ca, cb = f"({a} - _mu_{a})", f"({b} - _mu_{b})"
            out[f"corr_{a}{b}"] = f"avg({ca} * {cb}) / (sqrt(avg({ca} * {ca})) * sqrt(avg({cb} * {cb})) + 1e-6D)"
    return out


def power_sums(a: str, width: int, pos: str = "pos") -> str:
    """SQL text: array of the squared transform at bins 1..width//2."""
    bins = []
    for k in range(1, width // 2 + 1):
        angle = f"{A.num(2.0 * 3.141592653589793 * k / width)} * {pos}"
        c = f"({a} - _mu_{a})"
        bins.append(f"pow(sum({c} * cos({angle})), 2) + pow(sum({c} * sin({angle})), 2)")
    return f"array({', '.join(bins)})"


def spectrum_features(spec: str, a: str, bands: Sequence[tuple[int, int]], prefix: str | None = None) -> dict[str, str]:
    """SQL text per feature of a power array column."""
    tot = A.let(A.vsum(spec), lambda t: f"{t} + 1e-8D")
    dom = {f"domfreq_{a}": f"CAST({A.argmax(spec)} + 1 AS DOUBLE)", f"dompow_{a}": f"array_max({spec}) / ({tot})"}
    if prefix:
        return {f"{prefix}_domfreq": dom[f"domfreq_{a}"], f"{prefix}_dompow": dom[f"dompow_{a}"]}
    weighted = A.vsum(f"transform({spec}, (p, i) -> p * (i + 1))")
    ent = A.let(tot, lambda t: "-" + A.fold(spec, lambda s, x: f"{s} + {x} / {t} * ln({x} / {t} + 1e-12D)"))
    out = {**dom, f"centroid_{a}": f"({weighted}) / ({tot})", f"specent_{a}": ent}
    for lo, hi in bands:
        out[f"band{lo}_{hi}_{a}"] = f"{A.vsum(f'slice({spec}, {lo + 1}, {hi - lo})')} / ({tot})"
    return out


def clip_features(samples: DataFrame, by, width: int, axes: Sequence[str] = AXES, pos: str = "pos",
                  bands: Sequence[tuple[int, int]] = BANDS, spectra: bool = True) -> DataFrame:
    """All features per clip: 78 for three axes and a width of 50. NaN becomes 0, infinities the largest double."""
    by = keys(by)
    many = len(axes) > 1
    rows = _prepared(samples, by, axes, pos, many)
    aggs: dict[str, str] = {}
    for a in axes:
        aggs.update(_moments(a))
    if many:
        aggs.update(_magnitude())
        aggs.update(_correlations(axes))
    names = [*axes, "m"] if many else list(axes)
    specs = {f"_s_{a}": power_sums(a, width, pos) for a in names} if spectra else {}
    out = rows.groupBy(*by).agg(*[E(t).alias(n) for n, t in {**aggs, **specs}.items()])
    derived = {f"{n}_{a}": f"_q_{a}[{i}]" for a in axes for i, n in enumerate(("q25", "med", "q75"))}
    if spectra:
        for a in axes:
            derived.update(spectrum_features(f"_s_{a}", a, bands))
        if many:
            derived.update(spectrum_features("_s_m", "m", bands, "mag"))
    return out.select(*by, *[E(A.clean(n)).alias(n) for n in aggs if not n.startswith("_q_")],
                      *[E(A.let(t, A.clean)).alias(n) for n, t in derived.items()])


def moments(samples: DataFrame, by, axes: Sequence[str] = AXES, pos: str = "pos") -> DataFrame:
    return clip_features(samples, by, 0, axes, pos, spectra=False)


def power_spectrum(samples: DataFrame, by, value: str, width: int, pos: str = "pos") -> DataFrame:
    """(clip, bin, power) of the centred signal, bins 1..width//2."""
    by = keys(by)
    rows = samples.withColumn(f"_mu_{value}", F.avg(value).over(Window.partitionBy(*by)))
    spec = rows.groupBy(*by).agg(E(power_sums(value, width, pos)).alias("_s"))
    return spec.select(*by, E("posexplode(_s)").alias("_i", "power")).select(*by, (F.col("_i") + 1).alias("bin"), "power")


def static_dynamic(samples: DataFrame, by, axes: Sequence[str] = AXES, pos: str = "pos") -> DataFrame:
    """Static set: clip means. Dynamic set: std, peak-to-peak and mean absolute difference of the centred signal."""
    by = keys(by)
    order = Window.partitionBy(*by).orderBy(pos)
    rows = samples
    for a in axes:
        rows = rows.withColumn(f"_d_{a}", F.col(a) - F.lag(a).over(order))
    return rows.groupBy(*by).agg(*[E(t).alias(n) for a in axes for n, t in (
        (f"static_{a}", f"avg({a})"), (f"std_{a}", f"stddev_pop({a})"), (f"ptp_{a}", f"max({a}) - min({a})"),
        (f"absdiff_{a}", f"avg(abs(_d_{a}))"))])


def mirror(signal: DataFrame, signs: dict[str, Sequence[int]], sensor: str = "sensor",
           axes: Sequence[str] = AXES) -> DataFrame:
    """Flip the axes of some sensors by a literal sign table."""
    for i, a in enumerate(axes):
        cases = " ".join(f"WHEN '{s}' THEN {v[i]}" for s, v in signs.items())
        signal = signal.withColumn(a, E(f"{a} * CASE CAST({sensor} AS STRING) {cases} ELSE 1 END"))
    return signal


def choose_signs(left: DataFrame, right: DataFrame, by, axes: Sequence[str] = AXES) -> DataFrame:
    """The axis flips of ``right`` whose window means lie closest to those of ``left``: one row (sx, sy, sz, dist).

    Both sides are per-window means with the same keys; the eight sign triples are literals.
    """
    by = keys(by)
    other = right.select(*by, *[F.col(a).alias(f"_r{a}") for a in axes])
    triples = ", ".join(f"named_struct('sx', {a}, 'sy', {b}, 'sz', {c})" for a in (1, -1) for b in (1, -1) for c in (1, -1))
    rows = left.join(other, by).withColumn("_s", E(f"explode(array({triples}))"))
    dist = "sqrt(" + " + ".join(f"pow({a} - _s.s{n} * _r{a}, 2)" for a, n in zip(axes, AXES)) + ")"
    scored = rows.groupBy("_s.sx", "_s.sy", "_s.sz").agg(F.avg(E(dist)).alias("dist"))
    return scored.orderBy("dist", F.desc("sx"), F.desc("sy"), F.desc("sz")).limit(1)
