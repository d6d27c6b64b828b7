"""Count and share constraints per group. Only a per-group vector is iterated, never the probability table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.session import SMALL_BYTES, cut, keys, measured_bytes


def _side(state: DataFrame):
    """How the per-group state joins the rows in every round: its size does not change, so it is measured once."""
    return F.broadcast if measured_bytes(state) <= SMALL_BYTES else (lambda df: df)


def sinkhorn(probs: DataFrame, by, q_null: float | str, iters: int = 50, p: str = "p", eps: float = 1e-9,
             every: int = 5) -> DataFrame:
    """Balance every group towards class shares [q_null, the rest uniform]; rows sum to one at the end.

    Row scaling is implied by the column scales, so the state is one vector per group and a round is one partial
    aggregation of the fixed table. ``q_null`` is a number or a column of ``probs`` that is constant per group.
    """
    by = keys(by)
    n = A.width_of(probs, p)
    qn = q_null if isinstance(q_null, str) else A.num(q_null)
    base = cut(probs.withColumn("_q", A.E(A.each(p, lambda x: f"{x} + {A.num(eps)}"))))
    start = base.groupBy(*by).agg(F.first(A.E(qn)).alias("_qn"), F.count(F.lit(1)).alias("_n"))
    target = f"transform(sequence(0, {n - 1}), c -> IF(c = 0, _qn, (1 - _qn) / {n - 1}) * _n)"
    state = cut(start.select(*by, A.E(target).alias("_t"), A.E(f"array_repeat(1D, {n})").alias("_v")))
    scaled = A.divide_by_sum(A.both("_q", "_v", lambda x, v: f"{x} * {v}"))
    side = _side(state)
    for step in range(1, iters + 1):
        rows = base.select(*by, "_q").join(side(state), by).select(*by, A.E(scaled).alias("_r"))
        cols = rows.groupBy(*by).agg(A.E(A.weighted_sums("_r", n, "1D")).alias("_col"))
        state = state.join(cols, by).select(*by, "_t", A.E(
            f"transform(_v, (v, c) -> v * _t[c] / (_col[c] + {A.num(eps)}))").alias("_v"))
        if step % every == 0 and step < iters:
            state = cut(state)
    return base.join(side(state), by).withColumn(p, A.E(scaled)).drop("_q", "_v", "_t")


def rate_map(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Least-squares line y = intercept + slope x, the correlation and the range of x."""
    return df.groupBy(*keys(by)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), A.E(A.corr(x, y)).alias("r"),
        F.min(x).alias("lo"), F.max(x).alias("hi"))


def null_rates(df: DataFrame, by, columns: dict[str, str]) -> DataFrame:
    """Share of class 0 per group for several label columns."""
    return df.groupBy(*keys(by)).agg(*[F.avg((F.col(c) == 0).cast("double")).alias(n) for n, c in columns.items()])


def shift_search(probs: DataFrame, rates: DataFrame, by: str, goal: float, shifts: Sequence[float],
                 iters: int = 50, p: str = "p", lo: float = 0.05, hi: float = 0.75) -> DataFrame:
    """The shift of all group rates whose balanced decisions come closest to an overall rate of class 0.

    All shifts are balanced in one pass, as part of the group key: one row per shift (shift, rate, miss).
    """
    from clipgraph.operators.probs import with_grid

    joined = probs.join(rates.select(by, F.col("q").alias("_rate")), by)
    many = with_grid(joined, [{"shift": float(s)} for s in shifts]) \
        .withColumn("_goal", A.E(f"least(greatest(_rate + shift, {A.num(lo)}), {A.num(hi)})"))
    out = sinkhorn(many, [by, "shift"], "_goal", iters, p)
    rate = out.groupBy("shift").agg(F.avg(A.E(f"IF({A.argmax(p)} = 0, 1D, 0D)")).alias("rate"))
    return rate.withColumn("miss", F.abs(F.col("rate") - goal))


def _bias_rounds(logp: DataFrame, state: DataFrame, by: list[str], l: str, step_expr, iters: int, every: int,
                 n: int, shifted: str) -> DataFrame:
    """Repeat: decide under the current shift, count per group, move the shift. Settled groups drop out."""
    done = None
    active = cut(state.withColumn("_live", F.lit(True)))
    side = _side(active)
    for step in range(1, iters + 1):
        rows = logp.join(side(active), by).select(*by, A.E(A.argmax(A.add(l, shifted))).alias("_c"))
        counts = rows.groupBy(*by).agg(A.E(
            "array(" + ", ".join(f"count_if(_c = {c})" for c in range(n)) + ")").alias("_cnt"))
        active = step_expr(active.join(counts, by))
        if step % every == 0 or step == iters:
            active = cut(active)
            settled = active.where(~F.col("_live"))
            done = settled if done is None else done.unionByName(settled)
            active = active.where("_live")
            if step < iters and not active.limit(1).count():
                break
    return done.unionByName(active).drop("_live")


def band_bias(logp: DataFrame, by, lo: float | str, hi: float | str, step: float = 0.1, iters: int = 200,
              l: str = "l", every: int = 4) -> DataFrame:
    """Per-group class biases that push the count of every class but 0 into [lo, hi]: (group, b).

    All classes outside their band move by one step per round; class 0 absorbs the rest. The round count is bounded,
    since a fixed step may swing around a band narrower than one step. ``lo`` and ``hi`` may be columns.
    """
    by = keys(by)
    n = A.width_of(logp, l)
    lo_, hi_ = (x if isinstance(x, str) else A.num(x) for x in (lo, hi))
    extra = [c for c in (lo, hi) if isinstance(c, str)]
    rows = cut(logp.select(*by, l))
    state = logp.groupBy(*by).agg(A.E(f"array_repeat(0D, {n})").alias("b"), *[F.first(c).alias(c) for c in extra])

    def move(df: DataFrame) -> DataFrame:
        new = (f"transform(b, (x, c) -> IF(c = 0, x, x + {A.num(step)} * "
               f"(CAST(_cnt[c] < {lo_} AS INT) - CAST(_cnt[c] > {hi_} AS INT))))")
        return df.withColumn("_nb", A.E(new)).withColumn("_live", F.col("_nb") != F.col("b")) \
                 .withColumn("b", F.col("_nb")).drop("_nb", "_cnt")

    return _bias_rounds(rows, state, by, l, move, iters, every, n, "b").drop(*extra)


def count_band(logp: DataFrame, by, lo, hi, step: float = 0.1, iters: int = 200, l: str = "l",
               out: str = "pred") -> DataFrame:
    """Decisions under the band biases."""
    bias = band_bias(logp, by, lo, hi, step, iters, l)
    return logp.join(bias, keys(by)).withColumn(out, A.E(A.argmax(A.add(l, "b")))).drop("b")


def pair_bias(logp: DataFrame, by, pairs: Sequence[tuple[int, int]], lo: float, hi: float, step: float = 0.05,
              iters: int = 200, l: str = "l", every: int = 4) -> DataFrame:
    """Per-group biases (-d, +d) on class pairs until the second one's share of the pair lies in [lo, hi]."""
    by = keys(by)
    n = A.width_of(logp, l)
    rows = cut(logp.select(*by, l))
    bias = logp.select(*by).distinct().withColumn("b", A.E(f"array_repeat(0D, {n})"))
    for a, c in pairs:
        shifted = f"transform(b, (x, i) -> CASE i WHEN {a} THEN -d WHEN {c} THEN d ELSE x END)"

        def move(df: DataFrame, a=a, c=c) -> DataFrame:
            share = f"_cnt[{c}] / (_cnt[{a}] + _cnt[{c}])"
            delta = (f"CASE WHEN _cnt[{a}] + _cnt[{c}] = 0 THEN 0D WHEN {share} < {A.num(lo)} THEN {A.num(step)} "
                     f"WHEN {share} > {A.num(hi)} THEN -{A.num(step)} ELSE 0D END")
            return df.withColumn("_m", A.E(delta)).withColumn("_live", F.col("_m") != 0) \
                     .withColumn("d", F.col("d") + F.col("_m")).drop("_m", "_cnt")

        moved = _bias_rounds(rows, bias.withColumn("d", F.lit(0.0)), by, l, move, iters, every, n, shifted)
        bias = moved.select(*by, A.E(shifted).alias("b"))
    return bias


def apply_bias(q: DataFrame, bias: DataFrame, by, beta: float, p: str = "p") -> DataFrame:
    """q * exp(beta * b), renormalised."""
    scaled = A.divide_by_sum(A.both(p, "b", lambda x, b: f"{x} * exp({A.num(beta)} * {b})"))
    return q.join(bias, keys(by)).withColumn(p, A.E(scaled)).drop("b")


def apply_band(q: DataFrame, by, lo, hi, beta: float, step: float = 0.1, iters: int = 200, p: str = "p",
               pairs: Sequence[tuple[int, int]] = (), share: tuple[float, float] = (0.4, 0.6),
               beta_pair: float = 0.0, pair_iters: int = 200) -> DataFrame:
    """Soft count band between stages, optionally composed with pair-share bands of their own strength."""
    if beta == 0 and beta_pair == 0:
        return q
    by = keys(by)
    logs = q.withColumn("l", A.E(A.log_each(p)))
    bias = band_bias(logs, by, lo, hi, step, iters)
    total = bias.select(*by, A.E(A.scale("b", A.num(beta))).alias("b"))
    if beta_pair > 0 and pairs:
        total = cut(total)
        moved = logs.join(total, by).withColumn("l", A.E(A.add("l", "b"))).drop("b")
        extra = pair_bias(moved, by, pairs, *share, iters=pair_iters).withColumnRenamed("b", "_pb")
        total = total.join(extra, by).select(*by, A.E(A.both(
            "b", "_pb", lambda x, y: f"{x} + {A.num(beta_pair)} * {y}")).alias("b"))
    return apply_bias(q, total, by, 1.0, p)
