"""The k best dot products from single precision and its bound against whole matrices in double precision."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from clipgraph.operators import blocks


def block(ids, x, marks):
    return blocks.Block(pa.table({"clip_id": ids, "f": pa.array(x.tolist(), pa.list_(pa.float64())), "grp": marks}))


@pytest.mark.parametrize("apart", [None, "grp"])
@pytest.mark.parametrize("block_rows", [7, 30, 5000])
def test_equal_to_whole_matrices(block_rows, apart):
    """Copies tie, some rows differ by less than single precision holds, lengths differ, one left row is not finite; the k best do not change with the blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * rng.choice([1e-3, 1.0, 50.0], (300, 1))
    x[40:90] = x[3]
    x[90:140] = x[4] * (1 + 1e-9 * rng.random((50, 1)))
    ids, marks = rng.permutation(1000)[:300], rng.integers(0, 4, 300)
    rights = block(ids, x, marks).cuts(block_rows, "clip_id")
    dots = blocks.TopDots(rights, "f", 5, "clip_id", "clip_id", True, apart)
    s = np.round(np.nan_to_num(np.einsum("id,jd->ij", x, x), nan=-np.inf, posinf=-np.inf, neginf=-np.inf), 12)
    s[np.equal.outer(marks, marks) if apart else np.eye(300, dtype=bool)] = -np.inf
    s[7] = -np.inf
    for part in block(ids, np.where(np.arange(300)[:, None] == 7, np.nan, x), marks).slabs(blocks.STRIP_ROWS):
        r, to, v = dots.strip(part)
        for i in range(part.rows):
            row = np.flatnonzero(ids == part["clip_id"][i])[0]
            finite = np.flatnonzero(np.isfinite(s[row]))
            want = finite[np.lexsort((ids[finite], -s[row][finite]))][:5]
            assert np.allclose(v[r == i], s[row][want], rtol=0, atol=2e-12 * max(1, np.abs(s[row][want]).max(initial=0)))
            if apart is not None or block_rows > 300:
                assert len(set(to[r == i])) == len(want)


def test_most_pairs_stay_in_single_precision(monkeypatch):
    """Blocks of thirty rows: only a few of all pairs are computed in double precision."""
    rng = np.random.default_rng(6)
    x, n, einsum = rng.normal(size=(3000, 16)), [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: n.append(len(a[1])) or einsum(*a))
    dots = blocks.TopDots(block(np.arange(3000), x, np.zeros(3000, int)).cuts(30, "clip_id"), "f", 10, "clip_id", "clip_id", True, None)
    r, to, v = dots.strip(block(np.arange(30), x[:30], np.zeros(30, int)))
    s = x[:30] @ x.T
    np.fill_diagonal(s, -np.inf)
    assert (to.reshape(30, 10) == np.argsort(-s, axis=1)[:, :10]).all() and sum(n) < 30 * 3000 / 10
