"""Cheapest matchings against all matchings of small groups and against the dual bound of larger ones."""
from __future__ import annotations

import numpy as np
import pytest

from clipgraph.operators import assignment


def brute(pairs, c0):
    """Smallest total cost over all one-to-one matchings, source by source."""
    cost = {}
    for s, t, d in pairs:
        cost.setdefault(s, {})[t] = min(d, cost.get(s, {}).get(t, np.inf))
    best = {frozenset(): 0.0}
    for s in cost:
        new = {}
        for used, c in best.items():
            options = [(used, c + c0)] + [(used | {t}, c + d) for t, d in cost[s].items() if t not in used]
            for key, v in options:
                new[key] = min(v, new.get(key, np.inf))
        best = new
    return min(best.values())


def random_pairs(seed, groups, n=7, m=7, share=0.6):
    rng = np.random.default_rng(seed)
    return [(g * 100 + i, g * 100 + 50 + j, float(np.round(rng.random(), rng.integers(1, 4)))) for g in range(groups) for i in range(n) for j in range(m) if rng.random() < share]


def total(rows, pairs, c0):
    sources = {s for s, _, _ in pairs}
    assert len({r["src"] for r in rows}) == len({r["dst"] for r in rows}) == len(rows)
    listed = {}
    for s, t, d in pairs:
        listed[s, t] = min(d, listed.get((s, t), np.inf))
    assert all(r["d"] == pytest.approx(listed[r["src"], r["dst"]]) for r in rows)
    return sum(r["d"] for r in rows) + c0 * (len(sources) - len(rows))


def test_small_groups_equal_all_matchings(spark):
    pairs = random_pairs(1, 40)
    df = spark.createDataFrame(pairs + pairs[:5] + [(pairs[0][0], pairs[0][1], 5.0), (None, 3, 0.1), (4, None, 0.1)], "src long, dst long, d double")
    rows = assignment.cheapest_matching(df, 0.7).collect()
    assert total(rows, pairs, 0.7) == pytest.approx(sum(brute([p for p in pairs if p[0] // 100 == g], 0.7) for g in range(40)), abs=1e-6)


def test_rounds_over_tables_find_the_same_cost(spark):
    pairs = random_pairs(2, 3, 4, 5)
    df = spark.createDataFrame(pairs, "src long, dst long, d double")
    rows = assignment.cheapest_matching(df, 0.8, limit=0, large_tol=1e-2).collect()
    want = sum(brute([p for p in pairs if p[0] // 100 == g], 0.8) for g in range(3))
    assert total(rows, pairs, 0.8) <= want + max(r["gap"] for r in rows) + 1e-9
    assert max(r["gap"] for r in rows) <= 1e-2


def test_large_group_is_within_its_dual_bound(spark):
    rng = np.random.default_rng(3)
    src, dst, gain = [], [], []
    for i in range(150):
        for j in rng.choice(160, 25, replace=False):
            src.append(i), dst.append(int(j)), gain.append(float(rng.random()))
    dst = np.unique(dst, return_inverse=True)[1].tolist()
    chosen, gap = assignment.auction(src, dst, gain, 1e-7)
    assert 0 <= gap + 1e-9 and gap <= 1e-7 and len({src[k] for k in chosen}) == len({dst[k] for k in chosen}) == len(chosen)


def test_greedy_is_not_enough(spark):
    # mutual best first takes (0, 10) and leaves 0.1 + 0.9, the cheapest is 0.2 + 0.15
    df = spark.createDataFrame([(0, 10, 0.1), (0, 11, 0.2), (1, 10, 0.15), (1, 11, 0.9)], "src long, dst long, d double")
    assert sorted((r["src"], r["dst"]) for r in assignment.cheapest_matching(df, 1.0).collect()) == [(0, 11), (1, 10)]


def test_nothing_to_match(spark):
    df = spark.createDataFrame([(0, 10, 2.0)], "src long, dst long, d double")
    assert assignment.cheapest_matching(df, 1.0).count() == 0 and assignment.cheapest_matching(df.limit(0), 1.0).count() == 0


def test_paths_find_the_cheapest_matching_of_crowded_targets():
    """Many sources for few targets: the matching costs as little as the auction's, and the prices prove it."""
    rng = np.random.default_rng(6)
    for n, m, each in ((40, 12, 5), (300, 280, 6), (60, 200, 30), (5, 1, 1)):
        src = np.repeat(np.arange(n), each)
        dst = np.concatenate([rng.choice(m, each, replace=False) for _ in range(n)])
        dst = np.unique(dst, return_inverse=True)[1]
        gain = np.round(rng.random(len(src)), 2) + 0.01
        chosen, gap = assignment.shortest_paths(src, dst, gain)
        assert len(set(src[chosen])) == len(set(dst[chosen])) == len(chosen) and abs(gap) < 1e-9
        other, bound = assignment.auction(src.tolist(), dst.tolist(), gain.tolist(), 1e-7)
        assert abs(gain[chosen].sum() - gain[other].sum()) <= bound + 1e-9


def test_a_component_of_the_old_limit_is_solved_in_a_task(spark):
    """Two thousand bidders and 30,000 pairs in one component."""
    rng = np.random.default_rng(9)
    listed = [(i, int(j), float(abs(rng.normal())) / 4) for i in range(2000) for j in (i * 5 + rng.choice(400, 15, replace=False)) % 9000]
    rows = assignment.cheapest_matching(spark.createDataFrame(listed, "src long, dst long, d double"), 0.9).collect()
    assert len(rows) == len({r["src"] for r in rows}) == len({r["dst"] for r in rows}) == 2000 and max(r["gap"] for r in rows) < 1e-6


def test_many_pairs_are_matched_by_prices(spark, monkeypatch):
    """One component of more pairs than ``limit``: prices rule most of them out, no round of the auction runs, and the cost is the auction's."""
    def never(*_):
        raise AssertionError("the auction over tables ran")

    monkeypatch.setattr(assignment, "_in_rounds", never)
    monkeypatch.setattr(assignment, "JOIN_PAIRS", 4, raising=False)
    rng = np.random.default_rng(12)
    for n, m, digits in ((30, 80, 6), (25, 25, 1), (40, 20, 2)):  # few and many equal costs, more sources than targets
        x, y = rng.random(n), rng.random(m)
        listed = [(i, 1000 + j, float(np.round(abs(x[i] - y[j]), digits))) for i in range(n) for j in range(m)]
        df = spark.createDataFrame(listed + [(i, j, d + 0.1) for i, j, d in listed[:200]] + [(None, 1000, 0.0), (0, None, 0.0)], "src long, dst long, d double")
        kept = [p for p in listed if p[2] < 0.6]
        rows = assignment.cheapest_matching(df, 0.6, limit=len(kept) - 1).collect()
        chosen, gap = assignment.auction([p[0] for p in kept], [p[1] - 1000 for p in kept], [0.6 - p[2] for p in kept], 1e-9)
        want = 0.6 * n - sum(0.6 - kept[k][2] for k in chosen)
        assert total(rows, listed, 0.6) == pytest.approx(want, abs=1e-7) and 0 < sum(r["gap"] for r in rows) / len(rows) < 1e-9
