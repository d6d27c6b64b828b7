"""Factor analysis of several blocks of columns: shared factors for all of them, own factors for each.

Block b of a row is ``L_b s + G_b u_b + noise`` with standard normal factors s (shared) and u_b (own), and a noise variance per
column. Own factors are integrated out block by block: with C_b = G_b G_b' + diag(noise), the precision of s given a row is
I + sum_b L_b' C_b^-1 L_b, a sum of one small matrix per block. The rows enter through one distributed second-moment table, cut into one strip per
block. An iteration is one job: each block gets the sum of the small matrices and the weights of all columns, makes the moments of
its own factors and regresses its columns on shared and own factors. The likelihood of the parameters comes with the next iteration, and the
search stops when it rises by less than ``tol`` a row.

The start is not random: shared loadings are the leading principal directions of all columns, own ones those of what is left in the block.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.subspace import pca_by
from clipgraph.operators.vectors import center_by, coordinates, gram_by
from clipgraph.session import cut

FLOOR = 1e-4  # of a noise variance


@dataclass
class Model:
    """Shared loadings (D x k), own loadings and columns per block, noise variances (D), log-likelihoods a row by iteration."""

    shared: np.ndarray
    own: list[np.ndarray]
    starts: np.ndarray
    noise: np.ndarray
    likelihood: list[float]

    def covariance(self) -> np.ndarray:
        """The covariance of a row that the model implies."""
        out = self.shared @ self.shared.T + np.diag(self.noise)
        for lo, g in zip(self.starts, self.own):
            out[lo:lo + len(g), lo:lo + len(g)] += g @ g.T
        return out

    def gain(self, observed: Sequence[int] | None = None) -> np.ndarray:
        """k x D map from a centred row to the posterior mean of the shared factors, from the observed columns only."""
        seen = np.zeros(len(self.noise), bool)
        seen[slice(None) if observed is None else np.asarray(observed)] = True
        weights, precision = np.zeros_like(self.shared), np.eye(self.shared.shape[1])
        for lo, g in zip(self.starts, self.own):
            cols = lo + np.flatnonzero(seen[lo:lo + len(g)])
            block = g[cols - lo] @ g[cols - lo].T + np.diag(self.noise[cols])
            weights[cols] = np.linalg.solve(block, self.shared[cols])
            precision += self.shared[cols].T @ weights[cols]
        return np.linalg.solve(precision, weights.T)


def _given_shared(l: np.ndarray, g: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C^-1 L of a block and its k x k contribution to the precision of the shared factors."""
    h = np.linalg.solve(g @ g.T + np.diag(noise), l)
    return h, l.T @ h


def _regress(s_bb: np.ndarray, strip_h: np.ndarray, l: np.ndarray, g: np.ndarray, noise: np.ndarray, spread: np.ndarray, h_s_h: np.ndarray):
    """New loadings and noise of a block. ``spread`` is the posterior covariance of the shared factors, ``strip_h`` the block's
    covariance with the weighted columns of all blocks, ``h_s_h`` that of the weighted columns with themselves."""
    x_s = strip_h @ spread  # block with shared factors
    s_s = spread + spread @ h_s_h @ spread
    q = g.shape[1]
    inner = np.linalg.inv(np.eye(q) + (g.T / noise) @ g)
    read = inner @ (g.T / noise)  # own factors from what the shared ones leave
    left = s_bb - l @ x_s.T - x_s @ l.T + l @ s_s @ l.T
    u_s, u_u = read @ (x_s - l @ s_s), inner + read @ left @ read.T
    x_u = (s_bb - x_s @ l.T) @ read.T
    both, moments = np.hstack([x_s, x_u]), np.block([[s_s, u_s.T], [u_s, u_u]])
    new = np.linalg.solve(moments, both.T).T
    return new[:, :-q] if q else new, new[:, len(s_s):], np.maximum(np.diag(s_bb) - (new * both).sum(1), FLOOR)


def _per_block(strips: DataFrame, solve, schema: str) -> dict[int, dict]:
    """Run ``solve(block, strip)`` where the strips are; results are small (columns x factors) and come back by block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        strip = np.stack(pdf.sort_values("i")["g"].to_numpy())
        return pd.DataFrame([{"block": int(pdf["block"].iloc[0]), **solve(int(pdf["block"].iloc[0]), strip)}])

    return {r["block"]: r.asDict() for r in strips.groupBy("block").applyInPandas(run, f"block int, {schema}").collect()}


def fit(df: DataFrame, x: str, blocks: Sequence[int], k: int, own: Sequence[int], max_iters: int = 50, tol: float = 1e-6) -> Model:
    """Fit on all rows; ``blocks`` are the numbers of columns, ``own`` the numbers of own factors of the blocks."""
    ends = np.cumsum(blocks)
    starts = ends - np.asarray(blocks)
    dims, order = int(ends[-1]), range(len(blocks))
    number = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: F.col("i") >= e)).alias("block")
    gram = cut(gram_by(df, None, x))
    n = gram.agg(F.max("n")).head()[0]
    # one strip of the covariance per block: D entries for each of its columns
    strips = cut(gram.select("i", number, A.E(A.each("g", lambda v: f"{v} / {A.num(float(n))}")).alias("g")))
    shared = np.zeros((dims, k))
    for r in pca_by(df, None, k, x).collect():  # k directions of D entries
        shared[:, r["j"]] = np.asarray(r["b"]) * np.sqrt(r["lam"] / n)

    def begin(b: int, strip: np.ndarray) -> dict:
        mine, l = strip[:, starts[b]:ends[b]], shared[starts[b]:ends[b]]
        value, vector = np.linalg.eigh(mine - l @ l.T)
        g = vector[:, ::-1][:, :own[b]] * np.sqrt(np.maximum(value[::-1][:own[b]], 0))
        return {"l": list(l), "g": list(g), "noise": np.maximum(np.diag(mine) - (l ** 2).sum(1) - (g ** 2).sum(1), np.diag(mine) / 10 + FLOOR)}

    form = "l array<array<double>>, g array<array<double>>, noise array<double>"
    read = lambda r, b: (np.array(r["l"]).reshape(-1, k), np.array(r["g"]).reshape(-1, own[b]), np.array(r["noise"]))
    params = {b: read(r, b) for b, r in _per_block(strips, begin, form).items()}
    likelihood: list[float] = []
    for _ in range(max_iters):
        given = {b: _given_shared(*params[b]) for b in order}
        weights = np.vstack([given[b][0] for b in order])
        spread = np.linalg.inv(np.eye(k) + sum(given[b][1] for b in order))

        def weigh(b: int, strip: np.ndarray, params=params, weights=weights) -> dict:
            _, g, noise = params[b]
            own_cov = g @ g.T + np.diag(noise)
            cross = strip @ weights
            return {"cross": list(cross), "part": list(weights[starts[b]:ends[b]].T @ cross),
                    "trace": float(np.trace(np.linalg.solve(own_cov, strip[:, starts[b]:ends[b]]))), "logdet": float(np.linalg.slogdet(own_cov)[1])}

        seen = _per_block(strips, weigh, "cross array<array<double>>, part array<array<double>>, trace double, logdet double")
        h_s_h = sum(np.array(seen[b]["part"]) for b in order)
        likelihood.append(float(-0.5 * (dims * np.log(2 * np.pi) + sum(seen[b]["logdet"] + seen[b]["trace"] for b in order)
                                        - np.linalg.slogdet(spread)[1] - np.trace(spread @ h_s_h))))
        if len(likelihood) > 1 and likelihood[-1] - likelihood[-2] < tol:
            break
        cross = {b: np.array(seen[b]["cross"]) for b in order}

        def renew(b: int, strip: np.ndarray, params=params, cross=cross, spread=spread, h_s_h=h_s_h) -> dict:
            l, g, noise = _regress(strip[:, starts[b]:ends[b]], cross[b], *params[b], spread, h_s_h)
            return {"l": list(l), "g": list(g), "noise": noise}

        params = {b: read(r, b) for b, r in _per_block(strips, renew, form).items()}
    return Model(np.vstack([params[b][0] for b in order]), [params[b][1] for b in order], starts, np.concatenate([params[b][2] for b in order]), likelihood)


def scores(df: DataFrame, x: str, model: Model, observed: Sequence[int] | None = None, out: str = "z") -> DataFrame:
    """Posterior mean of the shared factors of every row, as a linear map of the centred row."""
    table = df.sparkSession.createDataFrame([(j, [float(v) for v in row]) for j, row in enumerate(model.gain(observed))], "j int, b array<double>")
    return coordinates(center_by(df, None, x), table, None, x, out=out)
