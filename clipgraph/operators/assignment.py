"""Cheapest one-to-one matching of candidate pairs, where staying alone has a cost.

A source that is matched pays the cost of its pair, one that stays alone pays ``c0``; the sum is smallest. The method is an auction:
free bidders offer for their best target as much more as it is better than their second best, the highest offer takes
the target, and prices rise until nobody is free. Prices may start anywhere only if every target is taken in the end, so the problem is first made
symmetric: beside the pair (i, j) of gain ``c0 - d`` stand a place of its own for every source, a bidder of its own for every target, and the
pair of those two, all of gain 0. Every bidder then finds a place, and the smallest increment is lowered phase by phase (prices kept)
until the dual gap, the sum of all profits and prices less the gain of the matching, is at most ``tol`` of the largest gain.

Pairs of gain 0 or less never match, which cuts the candidates into connected components. Components of at most ``limit`` pairs are solved in
tasks, many to a task, by shortest augmenting paths: bidders come one by one, and prices rise only along the path that the new one takes.
Larger ones run the auction in rounds over tables (prices per target, best and second best offer per bidder), where no component is
ever in one task. Both end with prices; the gap of a component bounds how far its cost is from the smallest.

Of a list of more than ``limit`` pairs most can take no part in a cheapest matching, and prices prove which: a few pairs of every source are matched first, then one pass over
all pairs looks for those that leave their source more than it has at these prices, the best of them join, and so on until no pair does. Then the prices hold
for all pairs and the matching is the cheapest of all. Sources, targets and the pairs that joined travel, the others are read where they lie.
"""
from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.operators.graph import components
from clipgraph.session import SMALL_BYTES, cut, measured_bytes, stored

JOIN_PAIRS = 16  # so many pairs of a source join in a round
TASK_PAIRS = 20_000  # a task group takes whole components, about so many pairs
STEP = 8  # the increment falls by this factor from phase to phase


def auction(src: Sequence[int], dst: Sequence[int], gain: Sequence[float], tol: float) -> tuple[list[int], float]:
    """Chosen pair numbers of one component (ids count from 0) and the dual gap."""
    n, m = max(src) + 1, max(dst) + 1
    places: list[list[tuple[int, float]]] = [[(m + i, 0.0)] for i in range(n)] + [[(j, 0.0)] for j in range(m)]
    for i, j, g in zip(src, dst, gain):
        places[i].append((j, g))
        places[n + j].append((m + i, 0.0))
    top = max(gain)
    prices, step = [0.0] * (n + m), top / 4
    while True:
        owner = [-1] * (n + m)
        free = deque(range(n + m))
        while free:
            a = free.popleft()
            best = second = -np.inf
            at = -1
            for b, g in places[a]:
                v = g - prices[b]
                if v > best:
                    best, second, at = v, best, b
                elif v > second:
                    second = v
            prices[at] += best - second + step
            if owner[at] >= 0:
                free.append(owner[at])
            owner[at] = a
        paid = {(i, j): g for i, j, g in zip(src, dst, gain)}
        gap = sum(max(g - prices[b] for b, g in places[a]) for a in range(n + m)) + sum(prices) - sum(paid.get((a, b), 0.0) for b, a in enumerate(owner))
        if gap <= tol * top or step <= 1e-15 * top:
            number = {pair: k for k, pair in enumerate(zip(src, dst))}
            return [number[a, b] for b, a in enumerate(owner[:m]) if a < n], gap
        step = max(step / STEP, min(step / 2, tol * top / (2 * (n + m))))


def shortest_paths(src: np.ndarray, dst: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, float]:
    """Chosen pair numbers of one component (ids count from 0) and the dual gap, which is left by rounding only."""
    return priced_paths(src, dst, gain)[:2]


def priced_paths(src: np.ndarray, dst: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Chosen pair numbers, the gap, the profit of every source and the price of every target.

    A source's profit is what its best target leaves it at the prices so far, at least 0 (staying alone). From a new source a path leads over a target
    to the source that holds it, and on; it ends at a free target or at a source that stays alone from now on, whichever costs the least profit.
    """
    order = np.argsort(src, kind="stable")
    dst, gain = dst[order], gain[order]
    n, m = int(src.max()) + 1, int(dst.max()) + 1
    starts = np.searchsorted(src[order], np.arange(n + 1))
    price, profit = np.zeros(m), np.zeros(n)
    owner, mate = np.full(m, -1), np.full(n, -1)  # the source of a target, the pair of a source
    far, by = np.full(m, np.inf), np.zeros(m, dtype=np.int64)  # distance of a target and the pair that leads to it
    for new in range(n):
        lo, hi = starts[new], starts[new + 1]
        profit[new] = max(0.0, (gain[lo:hi] - price[dst[lo:hi]]).max(initial=0.0))
        end, last, alone = profit[new], -1, new
        seen, done, heap, touched = [(new, 0.0)], [], [], []
        x, at = new, 0.0
        while True:
            lo, hi = starts[x], starts[x + 1]
            to = dst[lo:hi]
            d = np.maximum(profit[x] + price[to] - gain[lo:hi], 0.0) + at
            for k in np.flatnonzero((d < far[to]) & (d < end)).tolist():
                j, v = int(to[k]), float(d[k])
                if v < far[j] and v < end:
                    far[j], by[j] = v, lo + k
                    touched.append(j)
                    if owner[j] < 0:
                        end, last, alone = v, j, -1
                    else:
                        heapq.heappush(heap, (v, j))
            while heap and heap[0][0] > far[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            at, j = heapq.heappop(heap)
            done.append((j, at))
            x = int(owner[j])
            seen.append((x, at))
            if at + profit[x] < end:
                end, last, alone = at + profit[x], -1, x
        for x, v in seen:
            profit[x] -= end - v
        for j, v in done:
            price[j] += end - v
        if alone >= 0 and alone != new:
            last, mate[alone] = int(dst[mate[alone]]), -1
        while last >= 0:  # every source on the path takes the target that led on
            k = int(by[last])
            x = int(np.searchsorted(starts, k, side="right")) - 1
            before = int(dst[mate[x]]) if mate[x] >= 0 else -1
            owner[last], mate[x] = x, k
            last = before
        far[touched] = np.inf
    left = np.maximum(np.maximum.reduceat(gain - price[dst], starts[:-1]), 0) if len(gain) else np.zeros(0)
    chosen = mate[mate >= 0]
    return order[chosen], float(left.sum() + price.sum() - gain[chosen].sum()), left, price


def _in_tasks(pairs: DataFrame, buckets: int, slack: float | None = None) -> DataFrame:
    """Match whole components, many components to a group. With ``slack``, which the gap takes in for every source, come a row (src, value) of every source's profit
    and one (dst, value) of every price above 0."""
    kinds, priced = dict(pairs.dtypes), slack is not None
    names = ["src", "dst", "_g", "_c", "gap"] + (["value"] if priced else [])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for c, one in f.groupby("_c", sort=False):
            (src, s), (dst, t) = pd.factorize(one["src"]), pd.factorize(one["dst"])
            chosen, gap, profit, price = priced_paths(src, dst, one["_g"].to_numpy(float))
            kept.append(one.iloc[chosen].assign(gap=gap + len(s) * (slack or 0.0)))
            if priced:
                kept += [pd.DataFrame({"src": s.astype(object), "_c": c, "value": profit}), pd.DataFrame({"dst": t[price > 0].astype(object), "_c": c, "value": price[price > 0]})]
        if not priced:
            return pd.concat(kept)[names]
        whole = {n: pd.concat([k[n] if n in k else pd.Series([None] * len(k), dtype=object) for k in kept], ignore_index=True) for n in names}
        return pd.DataFrame({n: v.astype("Float64") if n in ("_g", "gap", "value") else v.astype(object) for n, v in whole.items()})

    group = F.pmod(F.xxhash64("_c"), F.lit(buckets)).alias("_k")
    schema = f"src {kinds['src']}, dst {kinds['dst']}, _g double, _c string, gap double" + (", value double" if priced else "")
    return pairs.groupBy(group).applyInPandas(run, schema)


def _in_rounds(pairs: DataFrame, tol: float) -> DataFrame:
    """The same auction with prices, offers and owners as tables."""
    s, t = F.concat(F.lit("s"), F.col("src")), F.concat(F.lit("t"), F.col("dst"))
    edges = cut(pairs.select(s.alias("a"), t.alias("b"), F.col("_g").alias("g"), "src", "dst")
                .unionByName(pairs.select(t.alias("a"), s.alias("b"), F.lit(0.0).alias("g")), allowMissingColumns=True)
                .unionByName(pairs.select(s.alias("a"), s.alias("b"), F.lit(0.0).alias("g")).distinct(), allowMissingColumns=True)
                .unionByName(pairs.select(t.alias("a"), t.alias("b"), F.lit(0.0).alias("g")).distinct(), allowMissingColumns=True))
    bidders = cut(edges.select("a").distinct())
    state = cut(edges.select("b").distinct().select("b", F.lit(0.0).alias("p"), F.lit(None).cast("string").alias("owner")))
    n, top = bidders.count(), pairs.agg(F.max("_g")).head()[0]
    step = top / 4
    first_two = Window.partitionBy("a").orderBy(F.desc("v"), "b")
    while True:
        state = state.withColumn("owner", F.lit(None).cast("string"))
        while True:
            free = bidders.join(state.where("owner IS NOT NULL").select(F.col("owner").alias("a")), "a", "left_anti")
            offers = edges.join(free, "a").join(state.select("b", "p"), "b").select("a", "b", "p", (F.col("g") - F.col("p")).alias("v"))
            two = offers.withColumn("_n", F.row_number().over(first_two)).where("_n <= 2").groupBy("a").agg(
                F.min_by("b", "_n").alias("b"), F.min_by("p", "_n").alias("p"), F.max("v").alias("v1"), F.min("v").alias("v2"))
            taken = two.groupBy("b").agg(F.max(F.struct((F.col("p") + F.col("v1") - F.col("v2") + step).alias("p"), F.col("a"))).alias("_o"))
            state = stored(state.join(taken, "b", "left").select("b", F.coalesce("_o.p", "p").alias("p"), F.coalesce("_o.a", "owner").alias("owner")))
            if not state.where("owner IS NULL").head(1):
                break
        profit = edges.join(state.select("b", "p"), "b").groupBy("a").agg(F.max(F.col("g") - F.col("p")).alias("v"))
        chosen = edges.join(state.select("b", F.col("owner").alias("a")), ["a", "b"])
        value = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0.0))).head()[0]
        gap = value(profit, "v") + value(state, "p") - value(chosen, "g")
        if gap <= tol * top or step <= 1e-15 * top:
            return chosen.where("src IS NOT NULL").select("src", "dst", F.col("g").alias("_g"), F.lit("").alias("_c"), F.lit(gap).alias("gap"))
        step = max(step / STEP, min(step / 2, tol * top / (2 * n)))


def _components(known: DataFrame) -> DataFrame:
    """The pairs with their component ``_c``."""
    s, t = F.concat(F.lit("s"), F.col("src")), F.concat(F.lit("t"), F.col("dst"))
    links = known.select(s.alias("src"), t.alias("dst"))
    nodes = links.select(F.col("src").alias("clip_id")).union(links.select("dst")).distinct()
    part = components(links, nodes).select(F.col("clip_id").alias("_s"), F.col("component").alias("_c"))
    return known.withColumn("_s", s).join(part, "_s").drop("_s")


def _grown(parts: DataFrame, new: DataFrame) -> DataFrame:
    """``parts`` and the new pairs of its sources, with the components of all: only components that a new pair joins are looked at."""
    of_src = parts.select("src", F.col("_c").alias("_a")).distinct()
    of_dst = parts.select("dst", F.col("_c").alias("_b")).distinct()
    ends = stored(new.join(of_src, "src").join(of_dst, "dst", "left").withColumn("_b", F.coalesce("_b", F.concat(F.lit("t"), F.col("dst")))))
    links = ends.where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    nodes = links.select(F.col("src").alias("clip_id")).union(links.select("dst")).distinct()
    moved = components(links, nodes).select(F.col("clip_id").alias("_c"), F.col("component").alias("_to"))
    both = parts.unionByName(ends.select("src", "dst", "_g", F.col("_a").alias("_c"))).join(moved, "_c", "left").withColumn("_c", F.coalesce("_to", "_c"))
    return both.groupBy("src", "dst", "_c").agg(F.max("_g").alias("_g"))


def _by_prices(known: DataFrame, c0: float, limit: int) -> DataFrame | None:
    """Match a few pairs of every source, let those join that prices do not rule out, until none is left; nothing when a component of them has more than ``limit`` pairs.

    A pair that has joined leaves its source no more than its profit, to the last bit, so every round adds pairs and the rounds end.
    """
    small = lambda df: F.broadcast(df) if measured_bytes(df) <= SMALL_BYTES else df
    parts, solved, least = None, None, 1e-12 * c0
    while True:
        if solved is None:
            left = known.withColumn("_v", F.col("_g"))
        else:
            profits = solved.where("dst IS NULL").select("src", F.col("value").alias("_u"))
            prices = solved.where("src IS NULL").select("dst", F.col("value").alias("_p"))
            left = known.join(small(profits), "src").join(small(prices), "dst", "left").withColumn("_v", F.col("_g") - F.coalesce("_p", F.lit(0.0)) - F.col("_u"))
        # the best pair of every source and of a share of its targets; both columns come from the same pair, as both follow the same order
        share = F.pmod(F.xxhash64("src", "dst"), F.lit(JOIN_PAIRS)).alias("_share")
        new = stored(left.where(F.col("_v") > least).groupBy("src", share).agg(F.max_by("dst", "_v").alias("dst"), F.max_by("_g", "_v").alias("_g")).select("src", "dst", "_g"))
        if not new.head(1):
            return solved.where("_g IS NOT NULL").select("src", "dst", "_g", "_c", "gap")
        parts = stored(_components(new) if parts is None else _grown(parts, new))
        if parts.groupBy("_c").count().where(F.col("count") > limit).head(1):
            return None
        solved = stored(_in_tasks(parts, 1 + parts.count() // TASK_PAIRS, least))


def cheapest_matching(pairs: DataFrame, c0: float, d: str = "d", limit: int = 1_000_000, large_tol: float = 1e-4) -> DataFrame:
    """src, dst, d and gap of the matched pairs.

    A repeated pair counts once, at its lowest cost; null ends never match. ``gap`` bounds, per component, how much the total cost may exceed the
    smallest; it is left by rounding (for components beyond ``limit`` pairs together at most ``large_tol`` of the largest saving ``c0 - d``). Of equally cheap matchings any one is taken.
    Of more than ``limit`` pairs in all, components are those of the pairs that prices do not rule out.
    """
    known = pairs.where((F.col(d) < c0) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    known = stored(known.select("src", "dst", F.col(d).alias(d), (F.lit(float(c0)) - F.col(d)).alias("_g")))
    done = _by_prices(known, float(c0), limit) if known.count() > limit else None
    if done is None:
        known = cut(known.groupBy("src", "dst").agg(F.min(d).alias(d)).withColumn("_g", F.lit(float(c0)) - F.col(d)))
        known = _components(known)
        sizes = known.groupBy("_c").agg(F.count("*").alias("_n"))
        sized = cut(known.join(sizes, "_c"))
        small, large = sized.where(F.col("_n") <= limit).drop("_n", d), sized.where(F.col("_n") > limit).drop("_n", d)
        done = _in_tasks(small, 1 + small.count() // TASK_PAIRS)
        if large.head(1):
            done = done.unionByName(_in_rounds(large, large_tol))
    return cut(done.select("src", "dst", (F.lit(float(c0)) - F.col("_g")).alias(d), "gap"))
