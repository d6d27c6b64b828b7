"""Quality rules under weak supervision.

Rules on text statistics vote good, bad or abstain. Votes are counted per vote pattern over all rows (at most 3 to the
power of the rule count), and expectation-maximisation on these counts estimates how often each rule is right and how
common good text is. A row is kept when its posterior probability of good text is at least one half.

A null text has no words and fails the base rule. An empty table gives an empty result. Repeated rows count each time.
Texts are read whole; one row's statistics take memory in proportion to its own text.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.session import cut

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = "n_words LONG, word_chars LONG, n_symbols LONG, n_dup_lines LONG, n_repeat_words LONG, n_lines LONG, n_distinct LONG, n_alpha LONG"


def stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``STATS``."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat, upto = 0, 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    return (n, sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat, lines, len(set(words)), sum(1 for w in words if w[0].isalpha() or w[-1].isalpha()))


#: A rule votes 1 (good), -1 (bad) or 0 (abstains); SQL over the statistics.
RULES = {
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN n_words = 0 OR word_chars > 12 * n_words OR word_chars < 2 * n_words THEN -1 WHEN word_chars BETWEEN 3 * n_words AND 10 * n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 50 * n_symbols <= n_words THEN 1 ELSE 0 END",
    "lines": "CASE WHEN n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 WHEN 20 * n_repeat_words <= n_words THEN 1 ELSE 0 END",
    "variety": "CASE WHEN n_words >= 50 AND 20 * n_distinct < 3 * n_words AND n_words < 2000 THEN -1 WHEN 10 * n_distinct >= 3 * n_words THEN 1 ELSE 0 END",
    "letters": "CASE WHEN 10 * n_alpha < 6 * n_words THEN -1 WHEN 10 * n_alpha >= 8 * n_words THEN 1 ELSE 0 END",
}


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good per vote pattern, and each rule's accuracies (right when good, right when bad).

    Rules start at 0.8; counts smoothed by a Beta(8, 2) prior keep every rule better than a coin where votes are few.
    """
    m = patterns.shape[1]
    acc, prior = np.full((2, m), 0.8), 0.8
    post = np.zeros(len(patterns))
    good, bad = patterns > 0, patterns < 0
    for _ in range(rounds):
        lg = np.log(prior) + good @ np.log(acc[0]) + bad @ np.log(1 - acc[0])
        lb = np.log(1 - prior) + bad @ np.log(acc[1]) + good @ np.log(1 - acc[1])
        new = 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))
        wg, wb = counts * new, counts * (1 - new)
        acc[0] = (wg @ good + 8) / (wg @ (good | bad) + 10)
        acc[1] = (wb @ bad + 8) / (wb @ (good | bad) + 10)
        acc = np.clip(acc, 0.55, 0.999)
        prior = np.clip((wg.sum() + 8) / (counts.sum() + 10), 0.05, 0.95)
        if np.abs(new - post).max(initial=0) < tol:
            break
        post = new
    return post, acc


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for f in frames:
            yield pd.concat([f[["doc_id"]].reset_index(drop=True), pd.DataFrame([stats(t) for t in f["text"]], columns=names, dtype="int64")], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {STATS}")


def judge(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Statistics, base_failed, votes, posterior ``quality`` and ``kept`` per row."""
    votes = [f"v_{r}" for r in rules]
    d = cut(with_stats(docs).withColumns({f"v_{r}": F.expr(e).cast("int") for r, e in rules.items()}))
    rows = d.groupBy(*votes).count().collect()  # bounded: 3 ** len(rules) patterns
    patterns = np.array([[r[v] for v in votes] for r in rows], dtype=int).reshape(len(rows), len(votes))
    post, _ = fit(patterns, np.array([r["count"] for r in rows], dtype=float))
    table = d.sparkSession.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, post)],
                                           ", ".join(f"{v} INT" for v in votes) + ", quality DOUBLE")
    out = d.join(F.broadcast(table), votes, "left")
    out = out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
