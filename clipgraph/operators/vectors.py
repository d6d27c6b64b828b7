"""Embedding-table operators: centring, scaling, projections, permutations."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.ordered import with_row_index
from clipgraph.session import join_small, keys


def _join_stats(df: DataFrame, stats: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    return join_small(df, stats, by, how)


def _in_order(order: str, value: str) -> str:
    """Aggregate: values collected in the order of a small index column."""
    return A.each(f"array_sort(collect_list(struct({order}, {value})))", lambda x: f"{x}.{value}")


def center_by(df: DataFrame, by, f: str = "f") -> DataFrame:
    by = keys(by)
    means = df.groupBy(*by).agg(A.vec_mean(f).alias("_mean"))
    return _join_stats(df, means, by).withColumn(f, A.E(A.sub(f, "_mean"))).drop("_mean")


def unit_by(df: DataFrame, by, f: str = "f") -> DataFrame:
    """Centre inside the group, then scale rows to unit length."""
    return center_by(df, by, f).withColumn(f, A.E(A.l2_normalize(f)))


def moments_by(df: DataFrame, by, f: str = "f") -> DataFrame:
    """Mean and population standard deviation per element, and the row count, per group."""
    m = df.groupBy(*keys(by)).agg(A.vec_moments(f).alias("_m"))
    m = m.select(*keys(by), vector_to_array("_m.mean").alias("mean"), vector_to_array("_m.variance").alias("_v"),
                 F.col("_m.count").alias("n"))
    pop = A.each("_v", lambda v: f"sqrt(greatest({v}, 0D) * (n - 1) / n)")
    return m.withColumn("std", A.E(pop)).drop("_v")


def zscore_by(df: DataFrame, by, f: str = "f", eps: float = 1e-6, min_rows: int = 0) -> DataFrame:
    """(x - mean) / (std + eps) per element; groups of at most ``min_rows`` rows become zero."""
    by = keys(by)
    stats = moments_by(df, by, f).withColumnsRenamed({"mean": "_mean", "std": "_std", "n": "_n"})
    z = A.both(A.sub(f, "_mean"), "_std", lambda x, s: f"{x} / ({s} + {A.num(eps)})")
    return _join_stats(df, stats, by).withColumn(f, A.E(f"IF(_n <= {min_rows}, {A.zeros(f)}, {z})")) \
                                     .drop("_mean", "_std", "_n")


MAX_OPEN_GROUPS = 64


def gram_by(df: DataFrame, by, f: str = "f", weight: str | None = None, center: bool = True) -> DataFrame:
    """Second-moment matrix per group, one row per matrix row: (group, i, g, s, n).

    ``g`` is row i of sum(w x x') (minus the mean part when ``center``), ``s`` the i-th weighted sum, ``n`` the weight
    total. Tasks add up the rows they hold; only d x d partial sums are shuffled, whatever the group size.
    """
    by = keys(by)
    if {"i", "g", "s", "n"} & set(by):
        raise ValueError("group columns must not be named i, g, s or n")
    types = dict(df.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by] + ["i int", "g array<double>", "s double", "n double"])
    rows = df.select(*by, f, *([weight] if weight else []))

    def partial(batches):
        open_sums: dict[tuple, list] = {}
        kinds: dict[str, pa.DataType] = {}

        def flush():
            for key, (g, s, n) in open_sums.items():
                d = len(s)
                cols = {b: pa.array([v] * d, kinds[b]) for b, v in zip(by, key)}
                yield pa.RecordBatch.from_pydict({
                    **cols, "i": pa.array(np.arange(d, dtype=np.int32)),
                    "g": pa.FixedSizeListArray.from_arrays(pa.array(g.ravel()), d).cast(pa.list_(pa.float64())),
                    "s": pa.array(s), "n": pa.array(np.full(d, n))})
            open_sums.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds.update({b: table.schema.field(b).type for b in by})
            for key, part in _split(table, by):
                x = part.column(f).combine_chunks()
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                w = part.column(weight).to_numpy() if weight else np.ones(len(x))
                xw = x * w[:, None]
                add = [xw.T @ x, xw.sum(0), w.sum()]
                if key in open_sums:
                    open_sums[key] = [a + b for a, b in zip(open_sums[key], add)]
                else:
                    if len(open_sums) >= MAX_OPEN_GROUPS:
                        yield from flush()
                    open_sums[key] = add
        yield from flush()

    sums = rows.mapInArrow(partial, schema).groupBy(*by, "i").agg(
        A.vec_sum("g").alias("g"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    if not center:
        return sums
    vec = sums.groupBy(*by).agg(
        A.E(_in_order("i", "s")).alias("_s"))  # d values
    return _join_stats(sums, vec, by).withColumn("g", A.E(A.both(
        "g", "_s", lambda g, x: f"{g} - s * {x} / n"))).drop("_s")


def _split(table: pa.Table, by: list[str]):
    """Rows of an Arrow batch per group key."""
    if not by:
        yield (), table
        return
    order = table.sort_by([(b, "ascending") for b in by])
    lists = [order.column(b).to_pylist() for b in by]
    tags = list(zip(*lists))
    start = 0
    for i in range(1, len(tags) + 1):
        if i == len(tags) or tags[i] != tags[start]:
            yield tags[start], order.slice(start, i - start)
            start = i


NO_BASIS = "CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"


def project_out(df: DataFrame, basis: DataFrame, by=None, f: str = "f", vec: str = "b") -> DataFrame:
    """f - sum_b (f . b) b for an orthonormal basis table (group, j, b). Groups without a basis row stay as they are."""
    by = keys(by)
    collected = basis.groupBy(*by).agg(F.collect_list(vec).alias("_basis"))
    # the basis is orthonormal, so every coefficient can come from the partly reduced row
    out = A.fold(f"coalesce(_basis, {NO_BASIS})", lambda acc, b: A.let(A.dot(acc, b), lambda c: A.both(
        acc, b, lambda x, y: f"{x} - {c} * {y}")), zero=f)
    return _join_stats(df, collected, by, "left").withColumn(f, A.E(out)).drop("_basis")


def coordinates(df: DataFrame, basis: DataFrame, by=None, f: str = "f", vec: str = "b", out: str = "z",
                order: str = "j", width: int | None = None) -> DataFrame:
    """Coordinates of each row in a basis table, in the order of ``order``.

    Groups with fewer directions get fewer coordinates (none without a basis row), or zeros up to ``width``.
    """
    by = keys(by)
    collected = basis.groupBy(*by).agg(
        A.E(_in_order(order, vec)).alias("_basis"))
    found = A.each(f"coalesce(_basis, {NO_BASIS})", lambda b: A.dot(f, b))
    if width is not None:
        found = A.let(found, lambda z: f"concat({z}, array_repeat(0D, greatest({width} - size({z}), 0)))")
    return _join_stats(df, collected, by, "left").withColumn(out, A.E(found)).drop("_basis")


def subtract_class_means(df: DataFrame, assign: str, n_classes: int, by, lam: float, f: str = "f") -> DataFrame:
    """Centre inside the group, then subtract lam x (own mixture of the group's soft class means). ``assign`` is a row's class weights."""
    by = keys(by)
    df = center_by(df, by, f)
    long = df.select(*by, F.col(f).alias("_f"), F.posexplode(assign).alias("_c", "_w")).where(F.col("_w") > 0)
    sums = long.groupBy(*by, "_c").agg(A.vec_sum(A.scale("_f", "_w")).alias("_s"), F.sum("_w").alias("_t"))
    means = sums.select(*by, F.struct(F.col("_c"), A.E(A.divide("_s", "(_t + 1e-9D)")).alias("m")).alias("_cm"))
    table = means.groupBy(*by).agg(F.collect_list("_cm").alias("_means"))
    mix = A.fold("_means", lambda acc, cm: A.both(acc, f"{cm}.m", lambda a, m: f"{a} + {m} * {assign}[{cm}._c]"),
                 zero=A.zeros(f))
    return _join_stats(df, table, by).withColumn("_mix", A.E(mix)) \
        .withColumn(f, A.E(A.both(f, "_mix", lambda x, m: f"{x} - {A.num(lam)} * {m}"))).drop("_mix", "_means")


def permute_within(df: DataFrame, by, ident: str, columns: list[str], seed: int) -> DataFrame:
    """Give every row the columns of another row of its group: position by id takes position by hash."""
    by = keys(by)
    left = with_row_index(df.drop(*columns), by, [ident], out="_i")
    shuffled = df.select(*by, ident, *columns).withColumn("_h", F.xxhash64(F.lit(seed), F.col(ident)))
    right = with_row_index(shuffled, by, ["_h", ident], out="_i").drop("_h", ident)
    return left.join(right, [*by, "_i"]).drop("_i")


def quadratic(df: DataFrame, cols: list[str], by=None) -> DataFrame:
    """Polynomial covariates: the columns, their squares and cross products, each z-scored over the group."""
    by = keys(by)
    terms = [F.col(c) for c in cols]
    names = list(cols)
    for i, a in enumerate(cols):
        for b in cols[i:]:
            terms.append(F.col(a) * F.col(b))
            names.append(f"{a}_{b}")
    return zscore_by(df.withColumn("x", F.array(*[t.cast("double") for t in terms])), by, "x"), names


def center_scale_by(df: DataFrame, by, f: str = "f", rescale: bool = True) -> DataFrame:
    """Remove the mean of every (group, sensor); rows of such a cell are then rescaled to the overall mean norm."""
    by = keys(by)
    out = center_by(df, by, f)
    if not rescale:
        return out
    ref = df.agg(F.avg(A.E(A.norm(f))).alias("_ref"))  # one row
    cell = out.groupBy(*by).agg(F.avg(A.E(A.norm(f))).alias("_cell"))
    return _join_stats(out, cell, by).crossJoin(F.broadcast(ref)) \
        .withColumn(f, A.E(A.scale(f, "_ref / (_cell + 1e-8D)"))).drop("_ref", "_cell")


def within_share(df: DataFrame, clip: str, value: str, by) -> DataFrame:
    """Share of a projection's variance that lies inside clips rather than between clip means."""
    by = keys(by)
    v = A.E(value)
    clips = df.groupBy(*by, clip).agg(F.avg(v).alias("m"), F.var_pop(v).alias("v"), F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*by).agg(F.var_pop(v).alias("_total"))
    inner = clips.groupBy(*by).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("_inner"))
    return _join_stats(inner, total, by).select(*by, (F.col("_inner") / F.col("_total")).alias("within_share"))


def eta2(df: DataFrame, value: str, label: str, by=None) -> DataFrame:
    """Share of a value's variance explained by a label."""
    by = keys(by)
    cells = df.groupBy(*by, label).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"),
                                       F.count(F.lit(1)).alias("n"))
    mean = F.sum("s") / F.sum("n")
    return cells.groupBy(*by).agg(
        ((F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("n") * mean * mean)
         / (F.sum("q") - F.sum("n") * mean * mean + 1e-12)).alias("eta2"))


def corr2(df: DataFrame, a: str, b: str, by=None, out: str = "r2") -> DataFrame:
    """Squared Pearson correlation, such as of a score with time."""
    return df.groupBy(*keys(by)).agg(A.E(f"pow({A.corr(a, b)}, 2)").alias(out))


def overlap(basis_a: DataFrame, basis_b: DataFrame, by=None, vec: str = "b") -> DataFrame:
    """Share of each direction of basis a inside the span of orthonormal basis b."""
    by = keys(by)
    b = basis_b.select(*by, F.col(vec).alias("_other"))
    joined = basis_a.join(b, by) if by else basis_a.crossJoin(b)
    return joined.groupBy(*by, "j").agg(F.sum(A.E(f"pow({A.dot(vec, '_other')}, 2)")).alias("share"))
