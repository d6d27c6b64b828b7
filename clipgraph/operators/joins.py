"""Joins: aligned probability lookups, successors, leave-one-out, nearest clips, matching of catalogues."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators import blocks
from clipgraph.session import cut, join_small, keys, rounds

E = A.E


def lookup_probs(clips: DataFrame, probs: DataFrame, on: Sequence[str] = ("clip_id", "sensor")) -> DataFrame:
    return clips.join(probs, list(on))


def align_models(probs: DataFrame, models: Sequence[str], on: Sequence[str] = ("clip_id",), model: str = "model",
                 p: str = "p") -> DataFrame:
    """One column per model, only rows all of them have. One shuffle of the long table."""
    cols = [F.max(F.when(F.col(model) == m, F.col(p))).alias(m) for m in models]
    full = " AND ".join(f"`{m}` IS NOT NULL" for m in models)
    return probs.where(F.col(model).isin(list(models))).groupBy(*on).agg(*cols).where(full)


def successor(clips: DataFrame, step: int, by="rec", start: str = "start", ident: str = "clip_id") -> DataFrame:
    """(clip, next clip) where the next one starts ``step`` later in the same recording."""
    by = keys(by)
    later = clips.select(*by, (F.col(start) - step).alias(start), F.col(ident).alias("next_id"))
    return clips.join(later, [*by, start])


def covered_by(clips: DataFrame, lengths: DataFrame, by="rec", sec: str = "sec", n: str = "n") -> DataFrame:
    """Clips whose recording exists in another source and is long enough there."""
    by = keys(by)
    other = lengths.select(*[F.col(b).alias(f"_{b}") for b in by], F.col(n).alias("_len"))
    cond = F.col(sec) < F.col("_len")
    for b in by:
        cond = cond & (F.col(b) == F.col(f"_{b}"))
    return clips.join(other, cond, "left_semi")


def leave_one_out(df: DataFrame, by: str, value: str, total: Sequence[str] = ()) -> DataFrame:
    """Mean of a value over all *other* groups: totals minus own, so groups are never paired."""
    total = list(total)
    own = df.groupBy(by, *total).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    whole = own.groupBy(*total).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    joined = own.join(whole, total) if total else own.crossJoin(F.broadcast(whole))
    return joined.select(by, *total, E("(_ts - _s) / nullif(_tn - _n, 0)").alias(value))


def exclude_groups(df: DataFrame, held: DataFrame, by) -> DataFrame:
    return df.join(held, keys(by), "left_anti")


def with_dim(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Dimension lookup; the optimizer broadcasts the dimension when its measured size allows."""
    return df.join(dim, keys(on), "left")


Distance = Callable[[blocks.Block, blocks.Block], np.ndarray]


def cosine_distance(left: str, right: str) -> Distance:
    """1 - cosine between two vector columns of a left and a right block."""
    def dist(a, b):
        x, y = a[left], b[right]
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        y = y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-12)
        return 1 - x @ y.T
    return dist


def euclidean_distance(left: str, right: str) -> Distance:
    def dist(a, b):
        x, y = a[left], b[right]
        sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
        return np.sqrt(np.maximum(sq, 0))
    return dist


def nearest(df: DataFrame, by, k: int, dist: Distance, columns: Sequence[str], ident: str = "clip_id") -> DataFrame:
    """The k nearest rows of the same group by any distance: (src, dst, d, rank). Partial top-k per block pair."""
    rows = df.select(*keys(by), ident, *columns)
    top = blocks.top_pairs(rows, rows, by, k, lambda a, b: -dist(a, b), ident, ident)
    return top.withColumn("d", -F.col("sim")).drop("sim")


def pair_candidates(df: DataFrame, by, k: int, dists: dict[str, Distance], columns: Sequence[str],
                    ident: str = "clip_id") -> DataFrame:
    """Union of the k nearest rows under each distance: distinct (group, src, dst)."""
    out = None
    for d in dists.values():
        part = nearest(df, by, k, d, columns, ident).select(*keys(by), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def pair_values(pairs: DataFrame, df: DataFrame, expr: dict[str, str], columns: Sequence[str],
                ident: str = "clip_id") -> DataFrame:
    """SQL expressions over both ends (a_<col>, b_<col>) of candidate pairs."""
    a = df.select(F.col(ident).alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(F.col(ident).alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = pairs.join(a, "src").join(b, "dst")
    drop = [f"{s}_{c}" for s in "ab" for c in columns]
    return joined.withColumns({n: E(t) for n, t in expr.items()}).drop(*drop)


def pair_ranks(pairs: DataFrame, df: DataFrame, by, dist: Distance, columns: Sequence[str], out_row: str = "row_rank",
               out_col: str | None = "col_rank", ident: str = "clip_id") -> DataFrame:
    """0-based rank of each candidate among *all* rows of the group, by row and by column.

    Candidates carry their distance as a bar and blocks only count the rows before it, so the distance matrix is
    never emitted.
    """
    by = keys(by)
    bars = _bars(pairs, df, by, {"d": dist}, columns, ident)
    out = pairs.join(_ranked(bars, df, by, dist, "d", "src", "dst", columns, out_row, ident), ["src", "dst"])
    if out_col:
        out = out.join(_ranked(bars, df, by, lambda a, b: dist(b, a).T, "d", "dst", "src", columns, out_col, ident), ["src", "dst"])
    return out


def _row_key(by: list[str], columns: Sequence[str]) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(*by, *columns)


def _ranked(bars: DataFrame, df: DataFrame, by: list[str], d: Distance, name: str, anchor: str, other: str, columns: Sequence[str], out: str,
            ident: str) -> DataFrame:
    """(src, dst, out): how many rows of the anchor's group come before the other row of a pair.

    Pairs are listed by anchor before its columns join them, so these travel once a row and not once a pair.
    """
    base = df.select(*by, ident, *columns)
    listed = blocks.list_bars(bars.select(F.col(anchor).alias("_q"), F.col(f"_{anchor}").alias("_k"), F.col(other).alias("bar_id"), F.col(name).alias("bar"),
                                          *[F.col(f"_{anchor}_{b}").alias(b) for b in by]))
    rows = base.select(F.col(ident).alias("_q"), _row_key(by, columns).alias("_k"), *columns).dropDuplicates(["_q", "_k"])
    counts = blocks.group_counts(listed.drop("_k"), base, by, beside=True)
    found = blocks.count_closer(listed.join(rows, ["_q", "_k"]).drop("_k"), base.withColumnRenamed(ident, "_b"), by, d, "_q", "_b", skip_id="_q", counts=counts)
    return found.select(F.col("_q").alias(anchor), F.col("bar_id").alias(other), F.col("closer").alias(out))


def _bars(pairs: DataFrame, df: DataFrame, by: list[str], dists: dict[str, Distance], columns: Sequence[str], ident: str) -> DataFrame:
    """The distances of the pairs, with the same kernels the counting uses: both ids, row keys and groups, and a column a distance; materialised."""
    import pyarrow as pa

    def side(own: str) -> DataFrame:
        return df.select(F.col(ident).alias(own), _row_key(by, columns).alias(f"_{own}"), *[F.col(b).alias(f"_{own}_{b}") for b in by],
                         *[F.col(c).alias(f"@{own}@{c}") for c in columns])

    rows = pairs.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    keep = [c for c in rows.columns if c[0] != "@"]
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{n}` double" for n in dists])

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            bars = {n: np.empty(t.num_rows) for n in dists}
            for lo in range(0, t.num_rows, 256):
                part = t.slice(lo, 256)
                left, right = (blocks.Block(part.select([f"@{s}@{c}" for c in columns]).rename_columns(list(columns))) for s in ("src", "dst"))
                for n, d in dists.items():
                    bars[n][lo:lo + 256] = np.diagonal(d(left, right))
            out = t.select(keep)
            for n, v in bars.items():
                out = out.append_column(n, pa.array(v))
            yield from out.to_batches()

    return cut(rows.mapInArrow(run, schema))


def rank_of_true(df: DataFrame, truth: DataFrame, by, dist: Distance, columns: Sequence[str],
                 ident: str = "clip_id") -> DataFrame:
    """How many rows of the group come before the true partner of each row: (src, dst, rank)."""
    return pair_ranks(truth.select("src", "dst"), df, by, dist, columns, "rank", None, ident)


def hit_rates(ranks: DataFrame, ks: Sequence[int], by=None) -> DataFrame:
    return ranks.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col("rank") < k).cast("double")).alias(f"hit_{k}") for k in ks])


def margin(df: DataFrame, by, dist: Distance, columns: Sequence[str], ident: str = "clip_id") -> DataFrame:
    """Nearest row and the relative gap to the second nearest: (src, dst, d1, d2, margin)."""
    two = nearest(df, by, 2, dist, columns, ident)
    wide = two.groupBy(*keys(by), "src").agg(F.min_by("dst", "rank").alias("dst"), F.min("d").alias("d1"),
                                             F.max("d").alias("d2"), F.count(F.lit(1)).alias("_n"))
    return wide.where("_n = 2").drop("_n").withColumn("margin", E("(d2 - d1) / (abs(d2) + 1e-6D)"))


def best_rank_sum(df: DataFrame, by, dists: dict[str, Distance], columns: Sequence[str], k: int = 16,
                  ident: str = "clip_id", max_rounds: int | None = None) -> DataFrame:
    """The row with the smallest sum of per-distance ranks, for every row: (src, dst, total).

    Candidates are the k nearest under each distance, with exact ranks. A row outside every list has a rank of at
    least k under each distance, so a best total below len(dists) * k is final; the other rows go again with 2k until none is left (a given limit of rounds raises).
    """
    by = keys(by)
    left, done = df, None
    sizes = df.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("_others"))
    for _ in rounds(max_rounds):
        cand = None
        for d in dists.values():
            rows = left.select(*by, ident, *columns)
            base = df.select(*by, ident, *columns)
            part = blocks.top_pairs(rows, base, by, k, lambda a, b, d=d: -d(a, b), ident, ident).select("src", "dst")
            cand = part if cand is None else cand.unionByName(part)
        cand = cut(cand.distinct())
        bars = _bars(cand, df, by, dists, columns, ident)
        for name, d in dists.items():
            cand = cand.join(_ranked(bars, df, by, d, name, "src", "dst", columns, f"_r_{name}", ident), ["src", "dst"])
        total = " + ".join(f"_r_{n}" for n in dists)
        best = cand.groupBy("src").agg(F.min(F.struct(E(total).alias("total"), F.col("dst"))).alias("_b")) \
                   .select("src", "_b.dst", "_b.total")
        best = cut(best.join(left.select(*by, F.col(ident).alias("src")).join(sizes, by), "src"))
        final = (F.col("total") < len(dists) * k) | (F.col("_others") <= k)
        part = best.where(final).select(*by, "src", "dst", "total")
        done = part if done is None else done.unionByName(part)
        rest = best.where(~final)
        if not rest.limit(1).count():
            return done
        left = cut(left.join(rest.select(F.col("src").alias(ident)), ident, "left_semi"))
        k *= 2
    raise RuntimeError(f"best_rank_sum: rows not final after {max_rounds} rounds")


def mutual_best(pairs: DataFrame, ratio: float | None = None, dmax: float | None = None, d: str = "d",
                by=None) -> DataFrame:
    """Pairs that are each other's best, under a limit on best / second best of the row and on the distance."""
    by = keys(by)
    row = Window.partitionBy(*by, "src").orderBy(d, "dst")  # one row's candidates
    ranked = pairs.withColumn("_second", F.lead(d).over(row)).withColumn("_rr", F.row_number().over(row)).where("_rr = 1")
    # a target may be the candidate of very many rows: its best one is a partly combined minimum, joined on the pair
    best = pairs.groupBy(*by, "dst").agg(F.min(F.struct(F.col(d).alias("_d"), F.col("src").alias("src"))).alias("_best")).select(*by, "dst", "_best.src")
    out = ranked.join(best, [*by, "src", "dst"], "left_semi")
    if ratio is not None:
        out = out.where(E(f"_second IS NULL OR {d} / (_second + 1e-9D) < {A.num(ratio)}"))
    if dmax is not None:
        out = out.where(F.col(d) < dmax)
    return out.drop("_second", "_rr")


def match_one_to_one(pairs: DataFrame, c0: float, d: str = "d", max_rounds: int | None = None) -> DataFrame:
    """One-to-one matching of candidate pairs in cost order: mutual best pairs are taken until none is left (a given limit of rounds raises).

    A repeated pair counts once, at its lowest cost. Pairs dearer than the cost c0 of staying alone never match. Not the cheapest assignment overall.
    """
    left = cut(pairs.where((F.col(d) < c0) & F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src", "dst").agg(F.min(d).alias(d)))
    done = left.limit(0)
    for i in rounds(max_rounds):
        best = cut(mutual_best(left, d=d))
        if not best.limit(1).count():
            return done
        done = done.unionByName(best)
        done = cut(done) if i % 32 == 31 else done
        left = cut(left.join(best.select("src"), "src", "left_anti").join(best.select("dst"), "dst", "left_anti"))
    if left.limit(1).count():
        raise RuntimeError(f"match_one_to_one: pairs left after {max_rounds} rounds")
    return done


def match_series(a: DataFrame, b: DataFrame, name_a: str, name_b: str, sec: str = "sec", value: str = "change",
                 min_n: int = 100, chunk: int = 1024, block: int = 256) -> DataFrame:
    """Best two counterparts of every series of one catalogue in another, by correlation at lag 0 over shared seconds (more than ``min_n``).

    Series are dealt into blocks and time into chunks. A task has one block of each catalogue in one chunk as two matrices; six matrix products give the
    sums of all its pairs at once, so a pair travels once a chunk and not once a second. Values are taken relative to the mean of their series. Rows without
    a value or a second do not count; of repeated seconds each counts with each.
    """
    def side(df: DataFrame, name: str, own: str, other: str, n_other: Column) -> DataFrame:
        known = df.select(F.col(name).alias("s"), F.col(sec).alias("t"), F.col(value).cast("double").alias("v")).where("s IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL")
        centred = join_small(known, known.groupBy("s").agg(F.avg("v").alias("_m")), ["s"]).withColumn("v", F.col("v") - F.col("_m")).drop("_m")
        dealt = centred.withColumn("c", F.floor(F.col("t") / chunk)).withColumn(own, F.pmod(F.xxhash64("s"), blocks_of(df, name)).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), (n_other - 1).cast("int"))))

    def blocks_of(df: DataFrame, name: str) -> Column:
        return F.lit(max(1, -(-counts[name] // block)))

    # two numbers: how many series each catalogue has
    counts = {name: df.agg(F.count_distinct(name)).head()[0] for df, name in ((a, name_a), (b, name_b))}
    left = side(a, name_a, "ba", "bb", blocks_of(b, name_b)).groupBy("c", "ba", "bb")
    right = side(b, name_b, "bb", "ba", blocks_of(a, name_a)).groupBy("c", "ba", "bb")
    kinds = dict(a.dtypes)[name_a], dict(b.dtypes)[name_b]
    sums = ["n", "x", "y", "xx", "yy", "xy"]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ["a", "b", *sums]})
        times, at = np.unique(np.concatenate([one["t"], two["t"]]), return_inverse=True)

        def matrices(f: pd.DataFrame, cols: np.ndarray) -> tuple:
            names, rows = np.unique(f["s"].to_numpy(), return_inverse=True)
            out = np.zeros((3, len(names), len(times)))  # numbers, sums and squares of the values of a second
            for m, v in zip(out, (1.0, f["v"].to_numpy(), f["v"].to_numpy() ** 2)):
                np.add.at(m, (rows, cols), v)
            return names, *out

        p, pn, pv, pq = matrices(one, at[:len(one)])
        q, qn, qv, qq = matrices(two, at[len(one):])
        got = [pn @ qn.T, pv @ qn.T, pn @ qv.T, pq @ qn.T, pn @ qq.T, pv @ qv.T]
        i, j = np.nonzero(got[0])
        return pd.DataFrame({"a": p[i], "b": q[j], **{c: m[i, j] for c, m in zip(sums, got)}})

    parts = left.cogroup(right).applyInPandas(run, f"a {kinds[0]}, b {kinds[1]}, " + ", ".join(f"{c} double" for c in sums))
    total = parts.groupBy(F.col("a").alias(name_a), F.col("b").alias(name_b)).agg(*[F.sum(c).alias(f"_{c}") for c in sums]).where(F.col("_n") > min_n)
    spread = "(_xx - _x * _x / _n) * (_yy - _y * _y / _n)"
    r = total.select(name_a, name_b, E(f"IF({spread} > 1e-24D * _xx * _yy, (_xy - _x * _y / _n) / sqrt({spread}), NULL)").alias("r"), F.col("_n").cast("long").alias("n"))
    w = Window.partitionBy(name_a).orderBy(F.desc_nulls_last("r"), name_b)
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def common_keys(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Keys present in every source."""
    out = frames[0].select(*on)
    for f in frames[1:]:
        out = out.intersect(f.select(*on))
    return out
