"""Exact pair computations inside groups of any size, as a grid of bounded row blocks.

Kernels see blocks of at most ``block_rows`` rows and return a reduction (top-k rows, counts, sums) instead of the pairs
themselves. What is shuffled are larger blocks, since a row travels once for every block of the other side: the right rows of a group are one
block, the left ones at most ``SPREAD``, so that the exchange grows with the rows, until a block holds ``SHIP_ITEMS`` numbers; from there on
blocks keep their size, a task its memory, and the exchange grows with the pairs. A task cuts its two blocks into those of the kernel and
merges what the kernel returned before anything leaves.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.session import keys, small_side

BLOCK_ROWS = 8192
SLAB_ROWS = 512
STRIP_ROWS, TILE_ROWS = 256, 2048  # products of a strip and a tile stay in the processor's cache
SPREAD = 6
SHIP_ITEMS = 4 << 20
MERGE_ROWS = 1 << 18


class Block:
    """Columnar view of one block: vectors as matrices, scalars as arrays."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        self.rows = table.num_rows
        self._parts = self.best = None

    def __getitem__(self, name: str) -> np.ndarray:
        c = self.table.column(name)
        c = c.chunk(0) if c.num_chunks else pa.array([], c.type)
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            flat = c.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(self.rows, -1) if self.rows else flat.reshape(0, 0)
        return c.to_numpy(zero_copy_only=False)

    def items(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and all values of a column of lists of any lengths."""
        c = self.table.column(name).combine_chunks()
        return pc.list_value_length(c).to_numpy(zero_copy_only=False), c.flatten().to_numpy(zero_copy_only=False)

    def slabs(self, size: int = SLAB_ROWS):
        for lo in range(0, self.rows, size):
            yield Block(self.table.slice(lo, size))

    def parts(self) -> list["Block"]:
        """The slabs, the same ones for every right block."""
        if self._parts is None:
            self._parts = list(self.slabs())
        return self._parts

    def raise_floor(self, row: np.ndarray, value: np.ndarray, k: int) -> None:
        """Take more values of rows into ``best``, the k best of each so far in falling order."""
        known = np.full((self.rows, k), -np.inf) if self.best is None else self.best
        row, value = np.append(np.repeat(np.arange(self.rows), k), row), np.append(known.ravel(), value)
        at = np.lexsort((-value, row))
        first = np.searchsorted(row[at], np.arange(self.rows))
        self.best = value[at][first[:, None] + np.arange(k)]

    def cuts(self, size: int, ident: str, order: str | None = None) -> list["Block"]:
        """Parts of about ``size`` rows in the order of ``order`` and the id; rows of one id stay together."""
        if self.rows <= size:
            return [self]
        rows = Block(self.table.sort_by([(c, "ascending") for c in ([order] if order else []) + [ident]]))
        ids = rows[ident]
        new = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, self.rows)  # ends of the runs of one id
        ends = np.unique(new[np.searchsorted(new, np.arange(size, self.rows + size, size).clip(max=self.rows))])
        return [Block(rows.table.slice(lo, hi - lo)) for lo, hi in zip(np.append(0, ends[:-1]), ends)]

    def sort(self, name: str) -> "Block":
        return Block(self.table.sort_by(name))


def _items(df: DataFrame) -> Column:
    """Largest number of values in a row."""
    arrays = [F.coalesce(F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array<")]
    return F.max(sum(arrays, F.lit(len(df.columns) - len(arrays))))


def group_counts(left: DataFrame, right: DataFrame, by, beside: bool = False) -> DataFrame:
    """(group, _left, _right, _items): rows per group on both sides and values per row, broadcast when the measured size allows.

    ``beside`` says that the left rows will carry the columns of the right ones besides their own.
    """
    by = keys(by)
    n = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_left"), _items(left).alias("_items"))
    if left is right:
        return small_side(n.withColumn("_right", F.col("_left")))
    m = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_right"), _items(right).alias("_more"))
    both = n.join(m, by) if by else n.crossJoin(m)
    return small_side(both.withColumn("_items", F.col("_items") + F.col("_more") if beside else F.greatest("_items", "_more")).drop("_more"))


def shipped_blocks(rows: str, least: Column) -> Column:
    """Number of blocks in which a side of a group travels: ``least`` or as many as keep a block within its size."""
    most = F.greatest(F.lit(1), F.floor(F.lit(SHIP_ITEMS) / F.greatest("_items", F.lit(1))))  # rows a block may hold
    return F.greatest(least, F.ceil(F.col(rows) / most))


def block_pairs(left: DataFrame, right: DataFrame, by, kernel: Callable[[Block, Block], pa.Table], schema: str,
                left_id: str, right_id: str, block_rows: int = BLOCK_ROWS, counts: DataFrame | None = None,
                clip_k: int | None = None, merge: Callable[[pa.Table], pa.Table] | None = None, order: str | None = None,
                over: Callable[[list[Block]], Callable[[Block], pa.Table] | None] | None = None) -> DataFrame:
    """Apply ``kernel`` to every (left block, right block) pair of a group.

    ``over`` takes the right blocks of a task at once and gives the function of a left block that stands for ``kernel`` and ``merge``, or nothing.

    ``counts`` is ``group_counts`` of the pair, when the caller has it already. With ``clip_k`` left rows carry
    ``_limit``, k clipped to the group size - 2. ``merge`` reduces what the kernel returned for one left block and several right ones.
    The right rows of a task are cut in the order of their ids, or of the column ``order`` and then the id, and rows of one id stay together.
    """
    by = keys(by)
    grid = group_counts(left, right, by) if counts is None else counts
    spread_left = F.least(F.ceil(F.col("_left") / block_rows), F.lit(SPREAD))
    grid = grid.select(*by, shipped_blocks("_left", spread_left).alias("_nl"), shipped_blocks("_right", F.lit(1)).alias("_nr"),
                       F.greatest(F.least(F.col("_left") - 2, F.lit(clip_k or 0)), F.lit(0)).alias("_limit"))
    pick = [*by, "_lb", "_rb"]

    def spread(df, ident, own, n_own, other, n_other):
        side = grid if clip_k is not None and own == "_lb" else grid.drop("_limit")
        joined = df.join(side, by) if by else df.crossJoin(side)  # without keys: one row
        out = joined.withColumn(own, F.pmod(F.xxhash64(ident), F.col(n_own)).cast("int")) \
                    .withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(n_other) - 1).cast("int")))) \
                    .drop("_nl", "_nr")
        # fresh attributes, so a frame can be paired with itself
        return out.select(*[F.col(c).alias(c) for c in out.columns])

    lhs = spread(left, left_id, "_lb", "_nl", "_rb", "_nr").groupBy(*pick)
    rhs = spread(right, right_id, "_rb", "_nr", "_lb", "_nl").groupBy(*pick)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rights = Block(b).cuts(block_rows, right_id, order)
        lefts = list(Block(a).slabs(block_rows)) or [Block(a)]
        if over and (whole := over(rights)):
            return joined([*map(whole, lefts)])
        out = []
        for x in lefts:
            part, rows = [], 0
            for y in rights:
                part.append(kernel(x, y))
                rows += part[-1].num_rows
                if merge and len(part) > 1 and rows > MERGE_ROWS:
                    part = [merge(joined(part))]
                    rows = part[0].num_rows // 2  # what is kept does not count whole, or every block would merge
            out.append(merge(joined(part)) if merge and len(part) > 1 else joined(part))
        return joined(out)

    return lhs.cogroup(rhs).applyInArrow(run, schema)


def joined(tables: list[pa.Table]) -> pa.Table:
    """The rows of all tables; empty ones do not know their types."""
    some = [t for t in tables if t.num_rows] or tables[:1]
    return some[0] if len(some) == 1 else pa.concat_tables(some, promote_options="permissive")


def reach(sim: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the finite entries that may be no smaller than their row's floor when rounded."""
    r, c = np.nonzero(sim >= (floor - 1e-11)[:, None])
    ok = np.isfinite(sim[r, c])
    return r[ok], c[ok]


def select_top(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k largest entries per row, the lower column on ties; -inf is never taken."""
    m = sim.shape[1]
    if m > k:
        cut_at = np.partition(sim, m - k, axis=1)[:, m - k][:, None]
        take = sim >= cut_at
        tied = np.flatnonzero(take.sum(1) > k)  # only these rows have more than k at or above the cut
        if len(tied):
            level = sim[tied] == cut_at[tied]
            above = take[tied] & ~level
            take[tied] = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    else:
        take = np.ones(sim.shape, bool)
    r, c = np.nonzero(take)
    ok = np.isfinite(sim[r, c])
    return r[ok], c[ok]


class TopDots:
    """Exact top-k dot products of left rows with the rows of right blocks, which arrive in the order of their ids.

    Products in single precision, in strips and tiles, leave out what their error bound keeps below the k best so far; the rest is computed in double precision.
    Rows that agree in ``apart`` never pair. The right rows have to be finite; a left row that is not has no result.
    """

    def __init__(self, rights: list[Block], f: str, k: int, left_id: str, right_id: str, skip_self: bool, apart: str | None):
        self.f, self.k, self.left_id, self.skip_self, self.apart = f, k, left_id, skip_self, apart
        rights = [b.sort(right_id) for b in rights if b.rows]
        self.y, self.ids = (np.concatenate([b[c] for b in rights]) if rights else np.zeros((0, 0)) for c in (f, right_id))
        self.marks = np.concatenate([b[apart] for b in rights]) if apart and rights else None
        ends = np.cumsum([0] + [b.rows for b in rights])
        self.tiles = [(lo, min(lo + TILE_ROWS, end)) for at, end in zip(ends[:-1], ends[1:]) for lo in range(at, end, TILE_ROWS)]
        self.reach = np.sqrt((self.y * self.y).sum(1).max(initial=0.0)) if rights else 0.0
        self.y32 = [self.y[lo:hi].astype(np.float32).T for lo, hi in self.tiles] if np.isfinite(self.reach) else []

    def strip(self, part: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row positions, right ids and values of the k best of every row."""
        x, own, k = part[self.f], part[self.left_id], self.k
        bad = ~np.isfinite(x).all(axis=1)
        x = np.where(bad[:, None], 0.0, x) if bad.any() else x
        size = np.sqrt((x * x).sum(1).max(initial=0.0)) * self.reach
        marks = part[self.apart] if self.marks is not None else None
        first = np.searchsorted(self.ids, own) if self.skip_self else np.full(part.rows, -1)
        single = size < 1e18
        x32, tol = x.astype(np.float32) if single else None, (x.shape[1] + 8) * 1.2e-7 * size + 1e-30
        best = (np.zeros(0, np.int64), self.ids[:0], np.zeros(0))
        floor, full, waiting, n = np.where(bad, np.inf, -np.inf).astype(np.float32)[:, None], False, [], 0

        def whole(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s = x @ self.y[lo:hi].T
            if marks is not None:
                np.putmask(s, marks[:, None] == self.marks[None, lo:hi], -np.inf)
            me = np.flatnonzero((first >= lo) & (first < hi))
            me = me[self.ids[first[me]] == own[me]]
            s[me, first[me] - lo] = -np.inf
            s[bad] = -np.inf
            np.round(s, 12, out=s)
            r, c = select_top(s, k)
            return r, c + lo, s[r, c]

        def exact(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ok = (c != first[r]) | (self.ids[c] != own[r])
            if marks is not None:
                ok &= marks[r] != self.marks[c]
            r, c = r[ok], c[ok]
            v = np.round(np.einsum("ij,ij->i", x[r], self.y[c]), 12)
            ok = np.isfinite(v)
            return r[ok], c[ok], v[ok]

        def take(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
            nonlocal best, floor, full
            r, to, v = (np.concatenate(z) for z in zip(best, (r, self.ids[c], v)))
            at = np.lexsort((to, -v, r))
            r, to, v = r[at], to[at], v[at]
            starts = np.searchsorted(r, np.arange(part.rows + 1))
            kept = np.arange(len(r)) - starts[r] < k
            best = (r[kept], to[kept], v[kept])
            have = np.flatnonzero(starts[1:] - starts[:-1] >= k)
            floor[have, 0] = np.nextafter((v[starts[have] + k - 1] - tol - 1e-11).astype(np.float32), np.float32(-np.inf))
            full = len(have) + bad.sum() == part.rows

        def settle() -> None:
            nonlocal waiting, n
            if waiting:
                take(*exact(*(np.concatenate(z) for z in zip(*waiting))))
            waiting, n = [], 0

        for (lo, hi), y32 in zip(self.tiles, self.y32):
            width, at = hi - lo, floor
            if not single:
                take(*whole(lo, hi))
                continue
            s = x32 @ y32
            if marks is not None:
                np.putmask(s, marks[:, None] == self.marks[None, lo:hi], -np.inf)
            if not full and width > k + 1:  # one of the k + 1 best may be the row itself
                at = np.maximum(floor, np.partition(s, width - k - 1, axis=1)[:, width - k - 1:width - k] - np.float32(2.5 * tol))
            hit = (s >= at).ravel().nonzero()[0]
            if len(hit) > 4 * (k + 1) * part.rows:  # very many ties
                take(*whole(lo, hi))
            elif len(hit):
                waiting.append((hit // width, hit % width + lo))
                n += len(hit)
                if not full or n > 4 * k * part.rows:
                    settle()
        settle()
        return best


def top_pairs(left: DataFrame, right: DataFrame, by, k: int, sim: Callable[[Block, Block], np.ndarray] | str,
              left_id: str = "clip_id", right_id: str = "clip_id", skip_self: bool = True,
              clip: bool = False, block_rows: int = BLOCK_ROWS, counts: DataFrame | None = None, order: str | None = None,
              apart: str | None = None) -> DataFrame:
    """Exact top-k right rows per left row by a similarity of two blocks: (group, src, dst, sim, rank).

    The name of a vector column in place of a similarity stands for the dot product; only then rows may be kept ``apart`` that agree in a column.

    ``clip`` limits k to the group size - 2. Blocks return at most k rows per left row, and the partial lists are
    merged by rank in the task and again after it, so no pair list is ever built.
    """
    by = keys(by)
    types = dict(left.dtypes)
    schema = ", ".join([f"{b} {types[b]}" for b in by]
                       + [f"src {types[left_id]}", f"dst {dict(right.dtypes)[right_id]}", "sim double"]
                       + (["_limit long"] if clip else []))
    names = [*by, "src", "dst", "sim"] + (["_limit"] if clip else [])

    def kernel(a: Block, b: Block) -> pa.Table:
        b = b.sort(right_id)
        cols: dict[str, list] = {n: [] for n in names}
        b_ids = b[right_id]
        for part in a.parts():
            if b.rows == 0:
                break
            s = sim(part, b)
            ids = part[left_id]
            if skip_self:  # block ids are sorted
                at = np.minimum(np.searchsorted(b_ids, ids), b.rows - 1)
                own = np.flatnonzero(b_ids[at] == ids)
                s[own, at[own]] = -np.inf
            r, c = (None, None) if part.best is None else reach(s, part.best[:, -1])
            if r is None or len(r) > 4 * k * part.rows:  # the first block, or very many ties
                np.round(s, 12, out=s)
                r, c = select_top(s, k)
            found = np.round(s[r, c], 12)
            part.raise_floor(r, found, k)
            for g in by:
                cols[g].append(part[g][r])
            cols["src"].append(ids[r])
            cols["dst"].append(b_ids[c])
            cols["sim"].append(found)
            if clip:
                cols["_limit"].append(part["_limit"][r])
        empty = np.array([])
        return pa.table({n: np.concatenate(v) if v else empty for n, v in cols.items()})

    def merge(t: pa.Table) -> pa.Table:
        src, dst, s = (t.column(c).to_numpy() for c in ("src", "dst", "sim"))
        at = np.lexsort((dst, -s, src))
        new = np.flatnonzero(np.append(True, src[at][1:] != src[at][:-1])[:len(at)])
        nth = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
        return t.take(at[nth < k])

    f = sim
    if isinstance(f, str):
        def sim(a: Block, b: Block) -> np.ndarray:
            s = a[f] @ b[f].T
            if apart:
                np.putmask(s, a[apart][:, None] == b[apart][None, :], -np.inf)
            return s

    def over(rights: list[Block]) -> Callable[[Block], pa.Table] | None:
        dots = TopDots(rights, f, k, left_id, right_id, skip_self, apart)
        if not np.isfinite(dots.reach):
            return None

        def run(a: Block) -> pa.Table:
            cols: dict[str, list] = {n: [] for n in names}
            for part in a.slabs(STRIP_ROWS) if dots.tiles else []:
                r, to, v = dots.strip(part)
                for n, values in ((n, part[n][r]) for n in (*by, *(["_limit"] if clip else []))):
                    cols[n].append(values)
                for n, values in (("src", part[left_id][r]), ("dst", to), ("sim", v)):
                    cols[n].append(values)
            return pa.table({n: np.concatenate(v) if v else np.array([]) for n, v in cols.items()})

        return run

    partial = block_pairs(left, right, by, kernel, schema, left_id, right_id, block_rows, counts, k if clip else None, merge, order, over if isinstance(f, str) else None)
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if clip:
        ranked = ranked.where(F.col("rank") <= F.col("_limit")).drop("_limit")
    return ranked


def list_bars(queries: DataFrame) -> DataFrame:
    """One row for the queries that differ in ``bar`` and ``bar_id`` only, with lists ``_bars`` and ``_targets`` of both."""
    same = [c for c in queries.columns if c not in ("bar", "bar_id")]
    return queries.groupBy(*same).agg(F.collect_list(F.struct(F.col("bar").alias("at"), F.col("bar_id").alias("to"))).alias("_bars")) \
                  .select(*same, F.col("_bars.at").alias("_bars"), F.col("_bars.to").alias("_targets"))


def count_closer(listed: DataFrame, base: DataFrame, by, dist: Callable[[Block, Block], np.ndarray],
                 query_id: str, base_id: str, skip_id: str | None = None,
                 block_rows: int = BLOCK_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """For queries of ``list_bars`` with thresholds and target ids: how many base rows come before the target.

    A base row comes before the target when its distance is smaller, or equal with a smaller id. Returns (query row id ``query_id``,
    ``bar_id``, closer). Only counts leave a task.
    """
    by = keys(by)
    types = dict(listed.dtypes)
    schema = f"{query_id} {types[query_id]}, bar_id {types['_targets'][6:-1]}, closer long"

    def kernel(a: Block, b: Block) -> pa.Table:
        ids, bars, n = [], [], []
        b_ids = b[base_id]
        for part in a.slabs():
            if b.rows == 0:
                break
            d = np.round(dist(part, b), 12)
            row = np.repeat(np.arange(part.rows), part.items("_bars")[0])
            values, targets = np.round(part.items("_bars")[1], 12), part.items("_targets")[1]
            for lo in range(0, len(row), SLAB_ROWS):
                r, bar, bar_id = (v[lo:lo + SLAB_ROWS] for v in (row, values, targets))
                near = d[r]
                before = (near < bar[:, None]) | ((near == bar[:, None]) & (b_ids[None, :] < bar_id[:, None]))
                if skip_id:
                    before &= part[skip_id][r][:, None] != b_ids[None, :]
                ids.append(part[query_id][r])
                bars.append(bar_id)
                n.append(before.sum(1))
        empty = np.array([])
        cat = lambda v: np.concatenate(v) if v else empty
        return pa.table({query_id: cat(ids), "bar_id": cat(bars), "closer": cat(n)})

    partial = block_pairs(listed, base, by, kernel, schema, query_id, base_id, block_rows, counts)
    return partial.groupBy(query_id, "bar_id").agg(F.sum("closer").alias("closer"))
