"""Order-dependent operators without one task per group.

A window over ``PARTITION BY recording`` sorts a whole recording in one task. Here rows are range-partitioned on
(group, order), numbered with per-partition offsets, and every later scan works on fixed-size chunks of the number
plus a small table of chunk totals, so a recording that holds a third of the data is spread over many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.session import cut, join_small, keys, small_side

CHUNK = 65536
_POSITION_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def with_row_index(df: DataFrame, by, order: Sequence[str | Column], out: str = "idx",
                   size: str | None = None) -> DataFrame:
    """Add the 0-based position of a row within its group (and, optionally, the group size)."""
    by = keys(by)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ordering = [F.col(b) for b in by] + order
    parts = cut(
        df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
        .withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright("_m", _POSITION_BITS))
    # one row per (group, partition): the first position and the number of rows before that partition
    heads = parts.groupBy(*by, "_pid").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *[F.col(b).alias(f"_h_{b}") for b in by], F.col("_pid").alias("_h_pid"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias("_size"),
    )
    cond = F.col("_pid") == F.col("_h_pid")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_h_{b}"))
    # one row per group and partition it touches: broadcast when measured small, so the rows are not shuffled again
    joined = parts.join(small_side(heads), cond)
    added = [(F.col("_m") - F.col("_first") + F.col("_off")).alias(out)]
    if size:
        added.append(F.col("_size").alias(size))
    return joined.select(*df.columns, *added)


def chunked(df: DataFrame, by, idx: str = "idx", before: int = 0, after: int = 0,
            chunk: int = CHUNK) -> tuple[DataFrame, Window]:
    """Cut groups into chunks; rows near an edge are also copied to the neighbour as ghosts (``_ghost``).

    Returns the frame and a window over (group, chunk) in index order. Drop ``_ghost`` rows after use.
    """
    by = keys(by)
    own = F.floor(F.col(idx) / chunk)
    pos = F.pmod(F.col(idx), F.lit(chunk))
    targets = [F.struct(own.alias("c"), F.lit(False).alias("g"))]
    if before:
        targets.append(F.when(pos >= chunk - before, F.struct((own + 1).alias("c"), F.lit(True).alias("g"))))
    if after:
        targets.append(F.when((pos < after) & (own > 0), F.struct((own - 1).alias("c"), F.lit(True).alias("g"))))
    out = df.withColumn("_target", F.explode(F.array_compact(F.array(*targets)))) \
            .select("*", F.col("_target.c").alias("_chunk"), F.col("_target.g").alias("_ghost")).drop("_target")
    return out, Window.partitionBy(*by, "_chunk").orderBy(idx)


def shifted(df: DataFrame, c: str, n: int, by, idx: str = "idx", out: str | None = None,
            chunk: int = CHUNK) -> DataFrame:
    """lag (n > 0) or lead (n < 0) of a column over an indexed group. Chunks hold at least |n| rows, so that a neighbour has the value."""
    out, chunk = out or f"{c}_shift", max(chunk, abs(n))
    parts, w = chunked(df, by, idx, before=max(n, 0), after=max(-n, 0), chunk=chunk)
    value = F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)
    return parts.withColumn(out, value).where(~F.col("_ghost")).drop("_chunk", "_ghost")


def running_sum(df: DataFrame, value: str, by, idx: str = "idx", out: str = "running",
                chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sum over an indexed group: sums inside chunks plus the totals of earlier chunks."""
    by = keys(by)
    parts, w = chunked(df, by, idx, chunk=chunk)
    inner = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = parts.groupBy(*by, "_chunk").agg(F.sum(value).alias("_tot"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_chunk", F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_carry"))
    return join_small(parts.withColumn("_in", inner), totals, [*by, "_chunk"]) \
                .withColumn(out, F.col("_in") + F.col("_carry")).drop("_in", "_carry", "_chunk", "_ghost")


def fill_forward_from(df: DataFrame, value: str, by, idx: str = "idx", out: str = "next_value",
                      chunk: int = CHUNK) -> DataFrame:
    """First non-null ``value`` at or after each row; rows after the last one get the last value of the group."""
    by = keys(by)
    parts, w = chunked(df, by, idx, chunk=chunk)
    inner = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    has = F.when(F.col(value).isNotNull(), F.col(idx))
    chunks = parts.groupBy(*by, "_chunk").agg(
        F.min_by(value, has).alias("_head"), F.max_by(value, has).alias("_tail"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    order = whole.orderBy("_chunk")
    chunks = chunks.select(
        *by, "_chunk",
        F.first("_head", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
        F.last("_tail", ignorenulls=True)
         .over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    return join_small(parts.withColumn("_in", inner), chunks, [*by, "_chunk"]) \
                .withColumn(out, F.coalesce("_in", "_later", "_last")) \
                .drop("_in", "_later", "_last", "_chunk", "_ghost")


def equal_parts(idx: Column, n: Column, parts: int) -> Column:
    """0-based part of a row when n rows are cut into parts whose sizes differ by at most one, larger ones first."""
    q, r = F.floor(n / parts), F.pmod(n, F.lit(parts))
    wide = r * (q + 1)
    return F.when(idx < wide, F.floor(idx / (q + 1))) \
            .otherwise(r + F.floor((idx - wide) / F.greatest(q, F.lit(1)))).cast("int")


def prefix_counts(df: DataFrame, by, value: str, weight: str, out: str = "before") -> DataFrame:
    """For one row per (group, value): the sum of ``weight`` over smaller values."""
    indexed = with_row_index(df, by, [value], out="_vi")
    summed = running_sum(indexed, weight, by, "_vi", "_run")
    return summed.withColumn(out, F.col("_run") - F.col(weight)).drop("_run", "_vi")


def quantiles(df: DataFrame, by, value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (group, q, value).

    Equal values are counted where they are and travel once, so ties spread over all tasks. A value holds the positions from the number
    of smaller ones on; each row picks the quantiles whose positions it holds, and two partial sums give the interpolation.
    """
    by = keys(by)
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    placed = join_small(prefix_counts(counts, by, "_v", "_c", "_b"), counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    held = lambda p: (p >= F.col("_b")) & (p < F.col("_b") + F.col("_c"))
    parts = []
    for q in qs:
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        low = F.when(held(lo), F.when(lo == hi, F.col("_v")).otherwise(F.col("_v") * (1 - (pos - lo))))
        high = F.when(held(hi) & (lo != hi), F.col("_v") * (pos - lo))
        parts += [F.struct(F.lit(float(q)).alias("q"), x.cast("double").alias("part")) for x in (low, high)]
    near = placed.select(*by, F.explode(F.filter(F.array(*parts), lambda x: x["part"].isNotNull())).alias("_p"))
    return near.groupBy(*by, F.col("_p.q").alias("q")).agg(F.sum("_p.part").alias(value))


def average_ranks(df: DataFrame, value: str, by=None, out: str = "rank") -> DataFrame:
    """1-based rank of every row, ties averaged; rows without a value keep a null rank."""
    by = keys(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_counts(counts, by, value, "_c", "_b")
    ranked = ranked.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])], (F.col("_b") + (F.col("_c") + 1) / 2).alias(out))
    same = F.lit(True)
    for i, c in enumerate([*by, value]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranked, same, "left").drop(*[f"_k{i}" for i in range(len(by) + 1)])
