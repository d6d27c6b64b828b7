"""Periodic runs of words, found by recursive frequency splitting.

A run is a stretch of words that repeats with its smallest period q (words q apart are identical), is at least max(6, 4 q) words
long and cannot be extended by a neighbouring word. Every word of a run therefore occurs at least four times in it. A word that
occurs less often inside the current segment can be part of no run there and splits the segment; the pieces are split again by
their own counts until nothing changes. Only the surviving segments are scanned for lags.

The lag scan looks at every q-th position of a segment: a run of 4 q words holds a whole window of 3 q words that starts at such a
position, so equal hashes of the windows [a, a + 2q) and [a + q, a + 3q) show every run (n log n windows for all lags together).
Each hit is extended to both sides by halving over the same hashes, and the run is then compared word by word, so hashes decide
the work and never the result.

Each text is one row and is searched alone: nothing is exchanged between tasks, memory is that of one Arrow batch and one text.
A null text has no words. Empty and short texts have no runs. Repeated rows each give their row; ties between runs of equal length go to the smaller
start, then the smaller period. Columns of the input other than ``keep`` and the text are not read and cannot clash; an empty table
gives no rows.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import SPACED

WORDS = re.compile(SPACED)
#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: Sequence[str]) -> np.ndarray:
    """Words as numbers; equal words have equal numbers."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [lo, hi) in which every word occurs often enough to be part of a run."""
    stable, active = [], [(0, len(ids))]
    while active:
        # all active segments in one pass: words are counted by (segment, word)
        lo, hi = np.array([s[0] for s in active]), np.array([s[1] for s in active])
        size = hi - lo
        owner = np.repeat(np.arange(len(active)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        _, inverse, count = np.unique(owner * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
        rare = count[inverse] < TIMES
        hit = np.zeros(len(active), dtype=bool)
        hit[owner[rare]] = True
        stable += [active[i] for i in np.nonzero(~hit & (size >= LEAST))[0]]
        # pieces between rare words of the segments that have any
        left = ~rare & hit[owner]
        where, part = at[left], owner[left]
        if not len(where):
            break
        new = np.append(True, (np.diff(where) != 1) | (np.diff(part) != 0))
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(where)) - 1
        active = [(int(a), int(b) + 1) for a, b in zip(where[first], where[last]) if b + 1 - a >= LEAST]
    return sorted(stable)


class Rolling:
    """Hashes of all word windows of a segment, modulo 2^64 over mixed word numbers."""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            z = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(31)
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(ids), MULTIPLIER, dtype=np.uint64))])
            # sum of z[i] * M^i before each position; windows are compared after scaling to one power
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(z * self.power[:-1], dtype=np.uint64)])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether windows at a < b of this length have equal hashes."""
        with np.errstate(over="ignore"):
            return (self.total[a + length] - self.total[a]) * self.power[b - a] == self.total[b + length] - self.total[b]


def lags(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    n, found, seen = len(ids), [], set()
    rolling = Rolling(ids)
    for q in range(1, n // TIMES + 1):
        a = np.arange(0, n - 3 * q + 1, q)
        a = a[(ids[a] == ids[a + q]) & (ids[a] == ids[a + 2 * q])]
        if not len(a):
            continue
        a = a[rolling.same(a, a + q, 2 * q)]
        if not len(a):
            continue
        for s in a[np.append(True, np.diff(a) != q)].tolist():
            # furthest end: the longest e with words [s, e) equal to [s + q, e + q); likewise to the left
            lo, hi = 2 * q, n - q - s
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if rolling.same(s, s + q, mid) else (lo, mid - 1)
            end = s + lo + q
            lo, hi = 0, s
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if rolling.same(s - mid, s - mid + q, mid) else (lo, mid - 1)
            start = s - lo
            if end - start < max(LEAST, TIMES * q) or (start, end) in seen:
                continue  # too short, or the same stretch with a smaller period
            if not np.array_equal(ids[start:end - q], ids[start + q:end]):
                raise ValueError("windows of different words have equal hashes")
            seen.add((start, end))
            found.append((start, end - start, q))
    return found


def runs(words: Sequence[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period."""
    ids = numbered(words)
    return sorted(((lo + s, n, q) for lo, hi in segments(ids) for s, n, q in lags(ids[lo:hi])), key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[str], found: Sequence[tuple[int, int, int]]) -> list[str]:
    """Words without those that any run holds after its first period."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in found:
        step[s + q] += 1
        step[s + n] -= 1
    return [w for w, c in zip(words, np.cumsum(step)) if c == 0]


def looped(words: list[str], doc_id: int | None) -> list[str]:
    """The words as the contract of the query has them: one row in ten ends in a planted loop (a null id never)."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def detect(docs: DataFrame, plant: bool = False, key: str = "doc_id") -> DataFrame:
    """key, n_runs, start, length, period, exponent_milli, runs (array of structs) and the collapsed text of every row.

    ``plant`` applies ``looped`` before the search.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text in zip(f["k"].to_numpy(dtype=object), f["t"]):
                words = WORDS.findall(text or "")
                if plant:
                    words = looped(words, None if pd.isna(doc) else int(doc))
                found = runs(words)
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                out.append((doc, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                            [{"start": s, "length": n, "period": q} for s, n, q in found], " ".join(collapsed(words, found))))
            frame = pd.DataFrame(out, columns=["k", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"], dtype=object)
            for c in ("start", "length", "period", "exponent_milli"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    given = docs.select(F.col(key).alias("k"), F.col("text").alias("t"))
    return given.mapInPandas(run, f"k {kind}, n_runs LONG, start LONG, length LONG, period LONG, exponent_milli LONG, "
                                  "runs ARRAY<STRUCT<start: LONG, length: LONG, period: LONG>>, collapsed STRING").withColumnRenamed("k", key)


def digest(found: DataFrame) -> DataFrame:
    """Hashes of the run list and of the collapsed text in place of both."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumns({"runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2("collapsed", 256)}).drop("runs", "collapsed")


def fingerprint(text: str) -> str:
    """Hash of a text as ``digest`` makes it."""
    return hashlib.sha256(text.encode()).hexdigest()
