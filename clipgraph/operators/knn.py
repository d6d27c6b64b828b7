"""Nearest-neighbour graphs inside groups: edge tables (group, src, dst, sim, rank, mutual)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import blocks
from clipgraph.operators.vectors import center_by, gram_by, unit_by
from clipgraph.session import cut, join_small, keys


def mutual(edges: DataFrame) -> DataFrame:
    """Flag edges whose reverse is present. Both directions of a pair meet under one key, in one shuffle."""
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.withColumn("mutual", F.count(F.lit(1)).over(pair) == 2)


def knn(df: DataFrame, by, k: int, f: str = "f", ident: str = "clip_id", center: bool = True,
        same: tuple[str, float] | None = None, cross: tuple[str, float] | None = None,
        is_mutual: bool = True, block_rows: int = blocks.BLOCK_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Exact cosine top-k inside groups, self excluded.

    ``same=(column, delta)`` subtracts delta from pairs that share the column; ``cross=(column, delta)`` subtracts it
    from pairs that differ, and an infinite delta leaves such pairs only as a last, never mutual, choice.
    """
    unit = unit_by(df, by, f) if center else df.withColumn(f, A.E(A.l2_normalize(f)))
    extra = [c for c, _ in (same, cross) if c] if same and cross else [(same or cross)[0]] if same or cross else []
    rows = unit.select(*keys(by), ident, f, *[c for c in extra if c not in keys(by)])

    def sim(a: blocks.Block, b: blocks.Block) -> np.ndarray:
        s = a[f] @ b[f].T
        if same:
            s = s - same[1] * (a[same[0]][:, None] == b[same[0]][None, :])
        if cross:
            other = a[cross[0]][:, None] != b[cross[0]][None, :]
            s = np.where(other, -1e4, s) if np.isinf(cross[1]) else s - cross[1] * other
        return s

    edges = blocks.top_pairs(rows, rows, by, k, sim if same or cross else f, ident, ident, clip=True, block_rows=block_rows, counts=counts)
    if not is_mutual:
        return edges.withColumn("mutual", F.lit(True))
    edges = mutual(edges)
    if cross:
        edges = edges.withColumn("mutual", F.col("mutual") & (F.col("sim") > -1e3))
    return edges


def knn_pruned(df: DataFrame, by, k: int, f: str = "f", ident: str = "clip_id", center: bool = True,
               cell_rows: int = blocks.BLOCK_ROWS, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """The same edges as ``knn``, for very large groups: pairs of a row and a cell that cannot matter are left out.

    Rows are put into the cell of their nearest pivot (a hash sample of the rows). The k-th neighbour inside the own
    cell bounds the search. A block measures the ball around its own rows of a cell (any centre will do), and by the triangle
    inequality a cell whose ball is further away than the bound holds no nearer row. Every other (row, cell) pair is searched, so the result is
    exact; how much is left out depends on how clustered the rows are. Rows travel as in ``knn``.
    """
    by = keys(by)
    unit = unit_by(df, by, f) if center else df.withColumn(f, A.E(A.l2_normalize(f)))
    rows = cut(unit.select(*by, ident, f))
    drawn = rows.where(F.pmod(F.xxhash64(ident), F.lit(cell_rows)) == 0).select(*by, ident)
    first = rows.groupBy(*by).agg(F.min(ident).alias(ident))  # every group has a pivot
    pivots = cut(rows.join(drawn.unionByName(first.select(*by, ident)).distinct().select(ident), ident, "left_semi"))

    def cosine(a: blocks.Block, b: blocks.Block) -> np.ndarray:
        return a[f] @ b[f].T

    home = blocks.top_pairs(rows, pivots, by, 1, cosine, ident, ident, skip_self=False, block_rows=block_rows)
    celled = cut(rows.join(home.select(F.col("src").alias(ident), F.col("dst").alias("_cell")), ident))
    inner = [*by, "_cell"]
    own = cut(blocks.top_pairs(celled, celled, inner, k, cosine, ident, ident, block_rows=block_rows))
    least = own.where(F.col("rank") == k).select(F.col("src").alias(ident), F.col("sim").alias("_least"))
    # rows with fewer than k cell mates search everywhere; rows of one id search for each other too
    times = celled.groupBy(ident).agg(F.count(F.lit(1)).cast("int").alias("_times")).join(least, ident, "left").na.fill(-np.inf, ["_least"])
    queries = celled.join(times, ident).withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")

    def within(a: blocks.Block, b: blocks.Block) -> np.ndarray:
        x, y = a[f], b[f]
        s = np.full((a.rows, b.rows), -np.inf)
        own_sq = (x * x).sum(1)
        cells, of = np.unique(b["_cell"], return_inverse=True)
        for c in range(len(cells)):
            at = np.flatnonzero(of == c)
            ball = y[at]
            mid = ball.mean(0)
            radius = np.sqrt(((ball - mid) ** 2).sum(1).max())
            far = np.sqrt(np.maximum(own_sq + mid @ mid - 2 * x @ mid, 0))
            # sim = (|x|^2 + |y|^2 - |x - y|^2) / 2 and |x - y| is at least far - radius
            best = (own_sq + (ball * ball).sum(1).max() - np.maximum(far - radius, 0) ** 2) / 2
            near = np.flatnonzero((best >= a["_least"] - 1e-9) & (a["_cell"] != cells[c]))
            if len(near):
                s[np.ix_(near, at)] = x[near] @ ball.T
        return s

    other = blocks.top_pairs(queries, celled, by, k, within, ident, ident, block_rows=block_rows, order="_cell")
    cols = [*by, "src", "dst", "sim"]
    both = own.select(*cols).unionByName(other.select(*cols))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst")))
    sizes = rows.groupBy(*by).agg(F.greatest(F.least(F.count(F.lit(1)) - 2, F.lit(k)), F.lit(0)).alias("_k"))
    return mutual(join_small(ranked.where(F.col("rank") <= k), sizes, by).where(F.col("rank") <= F.col("_k")).drop("_k"))


def knn_fused(df: DataFrame, by, k: int, sim, columns: list[str], ident: str = "clip_id",
              block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Mutual top-k under any block similarity ``sim(left_block, right_block) -> matrix``."""
    rows = df.select(*keys(by), ident, *columns)
    return mutual(blocks.top_pairs(rows, rows, by, k, sim, ident, ident, clip=True, block_rows=block_rows))


def knn_switched(df: DataFrame, by, k: int, fa: str, fb: str, key: str, calibrate: bool = False,
                 ident: str = "clip_id") -> DataFrame:
    """Similarity of ``fb`` for pairs that share ``key`` and of ``fa`` otherwise.

    With ``calibrate`` the second one is mapped to the mean and spread of the first over the sharing pairs. Both
    moments over all pairs follow from vector sums and Gram matrices, so no pair is formed for them.
    """
    by = keys(by)
    rows = df.withColumns({fa: A.E(A.l2_normalize(fa)), fb: A.E(A.l2_normalize(fb))})
    if calibrate:
        stats = None
        for f, tag in ((fa, "a"), (fb, "b")):
            gram = gram_by(rows.withColumnRenamed(key, "_key"), [*by, "_key"], f, center=False)
            one = gram.groupBy(*by, "_key").agg(
                F.sum(A.E(A.dot("g", "g"))).alias("s2"), F.sum(F.col("s") * F.col("s")).alias("s1"), F.max("n").alias("n"))
            part = one.groupBy(*by).agg(F.sum(F.col("n") * F.col("n")).alias("m"),
                                        F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
            mean = F.col("s1") / F.col("m")
            part = part.select(*by, mean.alias(f"_m{tag}"),
                               F.sqrt((F.col("s2") - F.col("m") * mean * mean) / (F.col("m") - 1)).alias(f"_s{tag}"))
            stats = part if stats is None else stats.join(part, by)
        rows = rows.join(stats, by)
        extra = ["_ma", "_sa", "_mb", "_sb"]
    else:
        extra = []

    def sim(a, b):
        sa, sb = a[fa] @ b[fa].T, a[fb] @ b[fb].T
        if calibrate:
            sb = (sb - a["_mb"][:, None]) / a["_sb"][:, None] * a["_sa"][:, None] + a["_ma"][:, None]
        return np.where(a[key][:, None] == b[key][None, :], sb, sa)

    return knn_fused(rows, by, k, sim, [fa, fb, key, *extra], ident)


def neighbor_mean(edges: DataFrame, df: DataFrame, f: str, ident: str = "clip_id") -> DataFrame:
    """Unit-length mean of the neighbours' vectors: (src, f)."""
    joined = edges.select("src", "dst").join(df.select(F.col(ident).alias("dst"), f), "dst")
    return joined.groupBy("src").agg(A.vec_mean(f).alias("_mean")).select("src", A.E(A.l2_normalize("_mean")).alias(f))


def modality_weights(df: DataFrame, by, k: int, fa: str, fb: str, temp: float, ident: str = "clip_id") -> DataFrame:
    """Per-row weight of modality a: softmax of (own affinity - affinity to the other graph's neighbours) / temp."""
    out = df
    for graph in (fa, fb):
        e = knn(df, by, k, graph, ident, center=False, is_mutual=False)
        for f in (fa, fb):
            near = neighbor_mean(e, df, f, ident).withColumnsRenamed({f: "_near", "src": ident})
            out = out.join(near, ident).withColumn(f"_r_{f}_{graph}", A.E(A.dot(f, "_near"))).drop("_near")
    ra = (F.col(f"_r_{fa}_{fa}") - F.col(f"_r_{fa}_{fb}")) / temp
    rb = (F.col(f"_r_{fb}_{fb}") - F.col(f"_r_{fb}_{fa}")) / temp
    return out.withColumn("weight", 1 / (1 + F.exp(rb - ra))).drop(*[f"_r_{f}_{g}" for f in (fa, fb) for g in (fa, fb)])


def knn_weighted_fusion(df: DataFrame, by, k: int, fa: str, fb: str, temp: float,
                        ident: str = "clip_id") -> DataFrame:
    """Mutual top-k under per-row modality weights, symmetrised."""
    unit = df.withColumns({fa: A.E(A.l2_normalize(fa)), fb: A.E(A.l2_normalize(fb))})
    rows = modality_weights(unit, by, k, fa, fb, temp, ident)

    def sim(a, b):
        w = 0.5 * (a["weight"][:, None] + b["weight"][None, :])
        return w * (a[fa] @ b[fa].T) + (1 - w) * (a[fb] @ b[fb].T)

    return knn_fused(rows, by, k, sim, [fa, fb, "weight"], ident)


def knn_local_scaling(df: DataFrame, by, k: int, r: int, f: str = "f", ident: str = "clip_id",
                      block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Hub-reducing similarity: cosine distance divided by the local scales, mapped to [0, 1] inside the group.

    The local scale of a row is its distance to the neighbour at 0-based position r.
    """
    by = keys(by)
    unit = df.withColumn(f, A.E(A.l2_normalize(f))).select(*by, ident, f)
    near = blocks.top_pairs(unit, unit, by, r + 1, lambda a, b: a[f] @ b[f].T, ident, ident, block_rows=block_rows)
    sizes = unit.groupBy(*by).agg(F.least(F.lit(r), F.count(F.lit(1)) - 2).alias("_r"))
    scale = join_small(near, sizes, by).where(F.col("rank") == F.col("_r") + 1) \
                .select(F.col("src").alias(ident), F.greatest(1 - F.col("sim"), F.lit(1e-6)).alias("sigma"))
    rows = unit.join(scale, ident)

    def raw(a, b):
        return -(1 - a[f] @ b[f].T) / np.sqrt(a["sigma"][:, None] * b["sigma"][None, :])

    types = dict(rows.dtypes)

    def extremes(a: blocks.Block, b: blocks.Block) -> pa.Table:
        lo, hi = np.inf, 0.0  # the diagonal is 0 by definition
        for part in a.slabs():
            if b.rows:
                s = np.where(part[ident][:, None] == b[ident][None, :], 0.0, raw(part, b))
                lo, hi = min(lo, s.min()), max(hi, s.max())
        n = 1 if a.rows and b.rows else 0
        return pa.table({**{g: a[g][:n] for g in by}, "lo": [lo][:n], "hi": [hi][:n]})

    schema = ", ".join([f"{g} {types[g]}" for g in by] + ["lo double", "hi double"])
    bounds = blocks.block_pairs(rows, rows, by, extremes, schema, ident, ident, block_rows) \
                   .groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    edges = knn_fused(rows, by, k, raw, [f, "sigma"], ident, block_rows)
    scaled = (F.col("sim") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)
    return join_small(edges, bounds, by).withColumn("sim", scaled).drop("lo", "hi")


def edge_weights(edges: DataFrame, sharp: float = 10.0) -> DataFrame:
    """Row-normalised weights exp(sharp * (sim - max sim)).

    Only mutual edges count; a row without any falls back to equal weights on all its directed neighbours.
    """
    w = Window.partitionBy("src")
    best = F.max(F.when(F.col("mutual"), F.col("sim"))).over(w)
    raw = F.when(best.isNull(), F.lit(1.0)) \
           .when(F.col("mutual"), F.exp(F.lit(float(sharp)) * (F.col("sim") - best)))
    weighted = edges.withColumn("_raw", raw).where(F.col("_raw").isNotNull())
    return weighted.withColumn("w", F.col("_raw") / (F.sum("_raw").over(w) + 1e-12)).drop("_raw")


def union_edges(*graphs: DataFrame) -> DataFrame:
    """All edges of several graphs, duplicates kept."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges only in the first graph (removed) and only in the second (added)."""
    ka, kb = a.select("src", "dst"), b.select("src", "dst")
    return ka.exceptAll(kb).withColumn("change", F.lit("removed")) \
             .unionByName(kb.exceptAll(ka).withColumn("change", F.lit("added")))


def anchor_prior(query: DataFrame, base: DataFrame, n_classes: int, k: int = 10, temp: float = 10.0,
                 by: str = "grp", f: str = "f", ident: str = "clip_id", label: str = "label",
                 smooth: float = 1e-6, block_rows: int = blocks.BLOCK_ROWS, edges: DataFrame | None = None) -> DataFrame:
    """Class prior of each row from its top-k labelled rows in *other* groups: (group, clip, p). A row without any has equal shares.

    ``edges`` is ``cross_group_knn`` of both with ``k`` or more neighbours, when the caller has it already.
    """
    edges = cross_group_knn(query, base, k, by, f, ident, block_rows) if edges is None else edges.where(F.col("rank") <= k)
    voted = edges.join(base.select(F.col(ident).alias("dst"), F.col(label).alias("_y")), "dst")
    best = F.max("sim").over(Window.partitionBy("src"))
    voted = voted.withColumn("_w", F.exp(F.lit(float(temp)) * (F.col("sim") - best)))
    sums = ", ".join(f"sum(IF(_y = {c}, _w, 0D)) + {A.num(smooth)}" for c in range(n_classes))
    votes = voted.groupBy("src").agg(A.E(f"array({sums})").alias("_v"))
    return query.select(by, ident).join(votes.withColumnRenamed("src", ident), ident, "left") \
                .select(by, ident, A.E(A.normalize(f"coalesce(_v, array_repeat(1D, {n_classes}))")).alias("p"))


def cross_group_knn(query: DataFrame, base: DataFrame, k: int, by: str = "grp", f: str = "f",
                    ident: str = "clip_id", block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Exact top-k rows of other groups for every row (src, dst, sim, rank)."""
    q = query.select(by, ident, A.E(A.l2_normalize(f)).alias(f))
    b = base.select(by, ident, A.E(A.l2_normalize(f)).alias(f))

    return blocks.top_pairs(q, b, None, k, f, ident, ident, block_rows=block_rows, apart=by)


def pool_neighbors(edges: DataFrame, df: DataFrame, key: str, f: str, ident: str = "clip_id") -> DataFrame:
    """Mean vector and count of the neighbours per value of ``key``; the row itself is one of its neighbours."""
    own = df.select(F.col(ident).alias("src"), F.col(ident).alias("dst"))
    pairs = edges.select("src", "dst").unionByName(own)
    joined = pairs.join(df.select(F.col(ident).alias("dst"), key, f), "dst")
    return joined.groupBy("src", key).agg(A.vec_mean(f).alias(f), F.count(F.lit(1)).alias("n"))
