"""Near duplicates by SimHash and vantage points.

A fingerprint sets a bit where more than half of a text's shingle hashes set it. Fingerprints within ``radius`` bits link.
Equal fingerprints are one point, so groups of exact copies cost one row.

Two fingerprints that differ in r bits agree wholly on at least blocks - r of ``blocks`` bit blocks. Every choice of that
many blocks is a space of its own: points at distance zero in it (the only branch the triangle bound leaves) meet in one
shard. Shards above ``leaf`` points are split further by vantage points: a point lives in the ring of its distance to the
shard's vantage point and visits the rings that the triangle bound cannot exclude (at most ``radius`` closer), so pairs across a
boundary meet exactly once. Inside a task a vantage-point tree over the whole 64 bits prunes with the same bound. A
shard gives at most one link per point (a spanning forest), never its pairs. Blocks grow with the number of points, so
that shards stay small; every choice is exact.

Null and empty texts have fingerprint zero and link like any other. Null ids take part in no minimum; a component of only
null ids has a null id. Repeated rows give repeated results.
"""
from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import LOWER_TABLE, Scratch, text_of
from clipgraph.session import cut

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; memory for the hashes is bounded by a chunk."""
    words = WORDS.findall((text or "").translate(LOWER_TABLE))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, dtype=np.int64)
    one = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        h = np.array([one(" ".join(words[i:i + shingle]).encode("utf-8", "surrogatepass"), seed) for i in range(lo, min(n, lo + CHUNK))], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fp_of(name: str = "text") -> Column:
    """The 64 bits of the fingerprint as a signed LONG."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return run(F.col(name))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint ``fp``."""
    return docs.select("doc_id", fp_of().alias("fp"))


def forest(points: np.ndarray, radius: int, leaf: int = 64) -> np.ndarray:
    """Index of the smallest point of each point's component within the shard, by a vantage-point tree.

    Each split keeps near, far and the boundary between them. A node whose points are all in one component already is
    left out, so a dense cluster costs its merges and not its pairs.
    """
    root = np.arange(len(points))

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        i, j = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius)
        x, y = a[i], b[j]
        apart = root[x] != root[y]
        for u, v in zip(x[apart].tolist(), y[apart].tolist()):
            lo, hi = sorted((root[u], root[v]))
            if lo != hi:
                root[root == hi] = lo

    stack = [(np.arange(len(points)), None)]
    while stack:
        a, b = stack.pop()
        other = a if b is None else b
        if not len(a) or not len(other) or (root[a] == root[other[0]]).all() and (root[other] == root[a[0]]).all():
            continue
        if min(len(a), len(other)) <= leaf:
            for lo in range(0, len(a), 4 * leaf):
                for at in range(0, len(other), 4 * leaf):
                    merge(a[lo:lo + 4 * leaf], other[at:at + 4 * leaf])
            continue
        d = np.bitwise_count(points[a] ^ points[a[0]]).astype(int)
        e = d if b is None else np.bitwise_count(points[b] ^ points[a[0]]).astype(int)
        cutoff = int(np.median(d))
        if cutoff == d.max():
            cutoff -= 1
        near_a, far_a, near_b, far_b = a[d <= cutoff], a[d > cutoff], other[e <= cutoff], other[e > cutoff]
        edge_a, edge_b = a[(d <= cutoff) & (d > cutoff - radius)], other[(e > cutoff) & (e <= cutoff + radius)]
        # the last one in is the next one out: boundaries come after both sides
        if b is None:
            stack += [(edge_a, edge_b), (far_a, None), (near_a, None)]
        else:
            back_a, back_b = a[(d > cutoff) & (d <= cutoff + radius)], other[(e <= cutoff) & (e > cutoff - radius)]
            stack += [(back_a, back_b), (edge_a, edge_b), (far_a, far_b), (near_a, near_b)]
    return root


def shards(points: DataFrame, n: int, radius: int, leaf: int) -> DataFrame:
    """(space, part, ring, fp): every pair within the radius shares a row triple at least once."""
    keep = max(1, math.ceil((math.log2(max(2, n / 256))) / 13)) if n > 256 else 1
    blocks = radius + keep
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in chosen) for chosen in combinations(range(blocks), keep)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    dealt = points.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("space"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
                                                    for i, m in enumerate(signed)])).alias("x")).select("x.*", "fp")
    sizes = dealt.groupBy("space", "part").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where("n > 1")
    d = dealt.join(sizes, ["space", "part"])
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).cast("int")
    rings = F.when(F.col("n") <= leaf, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(far - radius, F.lit(0)), far))
    return d.select("space", "part", F.explode(rings).alias("ring"), "fp")


def links(points: DataFrame, radius: int = 4, leaf: int = 4096, batch: int = 20_000) -> DataFrame:
    """Links (a < b) between distinct fingerprints that span all components within ``radius`` bits."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["space", "part", "ring", "fp"], ignore_index=True)
        keys, p = f[["space", "part", "ring"]].to_numpy(), f["fp"].to_numpy(dtype=np.int64)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        out = [np.zeros((0, 2), dtype=np.int64)]
        for lo, hi in zip(starts, np.append(starts[1:], len(p))):
            if hi - lo > 1:
                one = p[lo:hi]
                root = forest(one.view(np.uint64), radius)
                some = root != np.arange(len(one))
                out.append(np.column_stack([one[root[some]], one[some]]))
        return pd.DataFrame(np.vstack(out), columns=["a", "b"])

    points = cut(points.select("fp").distinct())
    n = points.count()
    # a task group takes many whole shards, about ``batch`` rows of them
    bucket = F.pmod(F.xxhash64("space", "part", "ring"), F.lit(max(8, 8 * n // batch)))
    return shards(points, n, radius, leaf).groupBy(bucket.alias("bucket")).applyInPandas(run, "a LONG, b LONG").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): alternating large-star and small-star steps until the edges no longer change, however many rounds that takes.

    A round keeps its edges only: the ones before and the files of its shuffles go with its end, since rounds are many and small.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))

    scratch, state = Scratch(edges.sparkSession), None
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = down.join(least(down), "u")
        old, edges = edges, scratch.save(small.select(F.col("m").alias("a"), F.col("v").alias("b"))
                                         .unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct())
        scratch.drop(old)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if new == state:
            return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    fps = cut(fingerprints(docs))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps, radius))
    joined = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    known = joined.join(least, "root").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row of every ``root`` in ``keyed`` (doc_id, text_key, root): the smallest id (null ids last), then the smallest text key; of repeated rows one."""
    stay = keyed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("_key")).select("_key")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_text"))
    kept = rows.join(stay, F.col("_id").eqNullSafe(F.col("_key.doc_id")) & (F.col("_text") == F.col("_key.text_key")), "left_semi")
    return kept.dropDuplicates(["_id", "_text"]).select("_row.*")


def text_key() -> Column:
    return F.sha2(text_of(), 256)


def keep_first(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One document of every component of fingerprints, chosen by id and text; null ids come last and are rows like any other."""
    keyed = cut(docs.select("doc_id", text_key().alias("text_key"), fp_of().alias("fp")))
    roots = components(links(keyed, radius))
    return first_rows(docs, keyed.join(roots, "fp", "left").select("doc_id", "text_key", F.coalesce("root", "fp").alias("root")))
