"""Best-fit packing of tokenised documents by exact complements.

Tokens are counted per document in parallel. Packing needs only how many pieces have each length (at most ``width``
numbers, whatever the corpus size): patterns of lengths are made on these counts and used as often as their scarcest length
allows. For the longest length left, single, pair and triple sums are looked up that fill the gap exactly; without one, the
longest fitting piece goes in and the rest of the gap is tried again. Pieces then find their place by their rank within
their length, numbered from per-bucket offsets, so no length passes through one task.

A null text counts as empty and gives one piece with the single id 0. Repeated rows are packed once each. No rows give no rows.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.session import cut

WIDTH = 2048
CACHE = 400_000
#: Texts whose new words are encoded together.
TOGETHER = 64
#: Letters that fold to lower case one by one, then marks that are no apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|*$%&#()]*)")


class Encoder:
    """Ids of whole texts. The tokenizer never merges across a blank or line end, nor between letters and the marks after them, so
    parts are put together from remembered words and marks; parts of any other form are encoded as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parts, self.words = Tokenizer.from_file(path), {}, {}
        # words end in a marked token, so many words can be encoded as one text and cut again
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.last[number] = token.endswith("</w>")

    def _learn(self, words: list[str]) -> None:
        """Ids of new words of plain letters or of plain marks."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends, data = np.nonzero(self.last[ids])[0] + 1, ids.tobytes()
        if len(ends) != len(words):
            raise ValueError("a word gave other than one word end")
        lo = 0
        for word, hi in zip(words, (4 * ends).tolist()):
            self.words[word] = data[lo:hi]
            lo = hi

    def _add(self, new: set[str]) -> None:
        plain, odd, missing = [], [], set()
        for p in new:
            m = PLAIN.fullmatch(p)
            if m is None:
                odd.append(p)
                continue
            word, marks = m[1].lower(), m[2]
            plain.append((p, word, marks))
            missing.update(x for x in (word, marks) if x and x not in self.words)
        if missing:
            self._learn(list(missing))
        words = self.words
        for p, word, marks in plain:
            self.parts[p] = words[word] + words[marks] if marks else words[word]
        if odd:
            for p, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
                self.parts[p] = np.array(e.ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for lo in range(0, len(texts), TOGETHER):
            split = [t.replace("\n", " ").split(" ") for t in texts[lo:lo + TOGETHER]]
            if len(self.parts) > CACHE:
                self.parts.clear()
            if len(self.words) > CACHE:
                self.words.clear()
            self.parts[""] = b""
            new = set().union(*split).difference(self.parts)
            if new:
                self._add(new)
            for parts in split:
                yield np.frombuffer(b"".join(map(self.parts.__getitem__, parts)) + b"\0\0\0\0", dtype="<u4")


def pieces(docs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(path)
        for f in frames:
            rows = []
            for doc, ids in zip(f["doc_id"], encode(["" if t is None else t for t in f["text"]])):
                for i, lo in enumerate(range(0, len(ids), width)):
                    part = ids[lo:lo + width]
                    rows.append((doc, i, lo, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece INT, start LONG, length LONG, ids_crc32 LONG")


def complement(have: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three lengths that fill the gap exactly and are in stock; larger pieces first."""
    if have[gap]:
        return [gap]
    stock = np.nonzero(have[:gap])[0]

    def pair(rest: int, counts: np.ndarray, most: int) -> list[int] | None:
        a = stock[(stock < rest) & (stock <= most) & (2 * stock >= rest)]
        ok = (counts[a] > 0) & (counts[rest - a] > (rest == 2 * a))
        return [int(a[ok][-1]), int(rest - a[ok][-1])] if ok.any() else None

    found = pair(gap, have, gap)
    if found:
        return found
    for x in stock[::-1]:
        if 3 * x < gap:
            break
        have[x] -= 1
        found = pair(gap - int(x), have, int(x))
        have[x] += 1
        if found:
            return [int(x), *found]
    return None


def patterns(counts: dict[int, int], width: int = WIDTH) -> list[tuple[list[int], int]]:
    """(lengths, times): patterns that use up all pieces. Each one exhausts a length, so there are at most ``width`` of them."""
    have = np.zeros(width + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out = []
    for top in range(width, 0, -1):
        while have[top]:
            used = [top]
            have[top] -= 1
            gap = width - top
            while gap:
                fill = complement(have, gap)
                if fill is None:
                    fits = np.nonzero(have[:gap])[0]
                    if not len(fits):
                        break
                    fill = [int(fits[-1])]
                for x in fill:
                    have[x] -= 1
                used += fill
                gap -= sum(fill)
            need = np.bincount(used, minlength=width + 1)
            times = 1 + int(min(have[x] // need[x] for x in set(used)))
            have -= need * (times - 1)
            out.append((used, times))
    return out


def slots(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Per length, consecutive ranges of ranks with their first sequence and their offset."""
    next_rank, rows, sequence = {}, [], 0
    for used, times in plan:
        offset = 0
        for x in used:
            first = next_rank.get(x, 0)
            rows.append((x, first, sequence, offset))
            next_rank[x] = first + times
            offset += x
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, path: str, width: int = WIDTH, bucket_rows: int = 100_000) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    d = cut(pieces(docs, path, width))
    counts = {r["length"]: r["count"] for r in d.groupBy("length").count().collect()}  # at most ``width`` rows
    table = slots(patterns(counts, width))
    buckets = max(8, sum(counts.values()) // bucket_rows)
    d = d.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    local = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32", "start")
    per = d.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    offsets = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (d.withColumn("_r", F.row_number().over(local) - 1).join(offsets.drop("_n"), ["length", "_b"])
              .withColumn("_rank", F.col("_before") + F.col("_r")))
    # at most a few slots per length and pattern: the key orders all slots by (length, first rank)
    shared = d.sparkSession.sparkContext.broadcast({x: (g["first"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for x, g in table.groupby("length")})

    @F.pandas_udf("sequence_id LONG, offset LONG")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(rank), 2), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for x in np.unique(lengths):
            first, sequence, offset = shared.value[x]
            at = np.nonzero(lengths == x)[0]
            i = np.searchsorted(first, ranks[at], side="right") - 1
            out[at, 0], out[at, 1] = sequence[i] + ranks[at] - first[i], offset[i]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_p", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")
