"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of ten words of the normalised benchmark items are the automaton's patterns; each document is normalised the same
way, scanned once, and hits are mapped back to word numbers and to code points of the original text. The automaton is
built once per task from a broadcast list of windows. The benchmark is a small, curated table; should its windows pass
``LIMIT`` bytes they are split over several automata, and the word places of their scans are united per row.

Null texts have no words. Items without words have no window; items with a null id count as item ``null``. Repeated
document rows give repeated results. An empty benchmark hits nothing.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import ALNUM, LOWER_TABLE, lowered, text_of

WORD = re.compile(ALNUM)
LIMIT = 64 << 20


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(w, n, items): distinct windows as blank-joined words, their word count and the items that hold them."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                         F.regexp_extract_all(lowered(text_of()), F.lit(ALNUM), F.lit(0)).alias("ws")).where("size(ws) > 0")
    return (words.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(ws) - {size - 1})), i -> slice(ws, i, {size}))")).alias("s"))
            .select("item", F.array_join("s", " ").alias("w"), F.size("s").alias("n")).groupBy("w", "n").agg(F.collect_set("item").alias("items")))


def scanner(listed: list[tuple[str, int, list[str]]]):
    """A function from a text to (words, hit words, items, original spans)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for w, n, items in listed:
        auto.add_word(f" {w} ", (n, tuple(items)))
    if listed:
        auto.make_automaton()

    def scan(text: str | None) -> tuple[int, np.ndarray, set[str], list[tuple[int, int]]]:
        low = (text or "").translate(LOWER_TABLE)
        words = WORD.findall(low)
        if not words or not listed:
            return len(words), np.zeros(0, dtype=int), set(), []
        found = [(end, n, items) for end, (n, items) in auto.iter(f" {' '.join(words)} ")]
        if not found:
            return len(words), np.zeros(0, dtype=int), set(), []
        # the blank behind word i stands at ends[i] of the joined text
        ends = np.cumsum([len(w) + 1 for w in words])
        delta, which = np.zeros(len(words) + 1, dtype=int), set()
        for end, n, items in found:
            last = int(np.searchsorted(ends, end))
            delta[last - n + 1] += 1
            delta[last + 1] -= 1
            which.update(items)
        hit = np.nonzero(np.cumsum(delta[:-1]) > 0)[0]
        at = [m.span() for m in WORD.finditer(low)]
        runs = np.split(hit, np.nonzero(np.diff(hit) > 1)[0] + 1)
        return len(words), hit, which, [(at[r[0]][0], at[r[-1]][1]) for r in runs]

    return scan


def blocks(found: DataFrame, limit: int) -> list[list[tuple[str, int, list[str]]]]:
    """The windows in lists of at most ``limit`` bytes each; normally a single one."""
    out, held = [[]], 0
    for r in found.orderBy("w").toLocalIterator():
        size = len(r["w"]) + sum(map(len, r["items"])) + 64
        if held + size > limit and out[-1]:
            out.append([])
            held = 0
        out[-1].append((r["w"], r["n"], sorted(r["items"])))
        held += size
    return out


def scan(docs: DataFrame, items: DataFrame, size: int = 10, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit ``spans`` (code points start:end) per row."""
    spark = docs.sparkSession
    lists = [spark.sparkContext.broadcast(b) for b in blocks(windows(items, size), limit)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words LONG, n_hit LONG, n_items LONG, items_sha256 STRING, contaminated BOOLEAN, spans STRING"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scans = [scanner(b.value) for b in lists]
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"]):
                hits, which, spans, n = set(), set(), [], 0
                for one in scans:
                    n, h, w, s = one(text)
                    hits.update(h.tolist())
                    which |= w
                    spans += s
                names = ",".join(sorted(which))
                rows.append((doc, n, len(hits), len(which), hashlib.sha256(names.encode()).hexdigest(), bool(hits), ",".join(f"{a}:{b}" for a, b in sorted(spans))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    lists = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks(windows(items), LIMIT)]

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scans = [scanner(b.value) for b in lists]
        for batch in batches:
            yield pd.Series([not any(len(one(t)[1]) for one in scans) for t in batch], dtype=bool)

    return docs.where(clean(F.col("text")))
