"""Toxicity from averaged subword embeddings.

A text is cut into windows of words; a window is the average of the embeddings of its words and their character n-grams
(hashed), followed by a softmax layer. A text is as toxic as its worst window, so long texts do not dilute a remark. Embeddings
and layer are trained jointly in numpy in one task, on at most ``max_rows`` labelled rows (those with the smallest hashes
of their ids; all toxic and clean rows where there are fewer) and all windows of each. The task reads one batch of training texts after the other
and keeps word numbers only; the driver sees the finished model.

Scoring maps over all whole texts with one scalar per n-gram, since averages and the layer are linear. Null and empty
texts score as the window without words. Without both classes in the sample every text scores 0. Repeated rows are scored each.
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import BATCHES, LOWER_TABLE, crc_rest, settings

WORD = re.compile(r"[^\W_]+(?:[@$!*'0-9][^\W_]+)*")
BUCKETS, DIM, WINDOW, PIECE = 1 << 16, 8, 6, 16
#: Words remembered by a task, and texts whose new words are looked up together.
CACHE, TOGETHER = 200_000, 128


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32, as the linear map of its bits."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


TABLE = _crc_table()


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (CRC-32 of the UTF-8 bytes) of each word and its character n-grams of three to five, each once: one array and the number of
    buckets a word."""
    marked = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(marked), dtype=np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of every character
    width = np.diff(np.append(at, len(data)))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int64), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(at))  # characters to the end of the word
    state = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    keys = [np.arange(len(words), dtype=np.int64) * BUCKETS + np.fromiter((zlib.crc32(m) % BUCKETS for m in marked), dtype=np.int64, count=len(words))]
    for n in range(1, 6):
        # the n-th character of the n-gram that starts at each character, byte by byte
        state = state[:len(at) - n + 1]
        char, many = at[n - 1:], width[n - 1:]
        for byte in range(int(many.max(initial=0))):
            wide = slice(None) if byte == 0 else np.flatnonzero(many > byte)
            now = state[wide]
            state[wide] = TABLE[(now ^ data[char[wide] + byte]) & np.uint32(0xFF)] ^ now >> np.uint32(8)
        if n > 2:
            whole = left[:len(state)] >= n
            keys.append(owner[:len(state)][whole] * BUCKETS + ((state[whole] ^ np.uint32(0xFFFFFFFF)) % BUCKETS))
    keys = np.unique(np.concatenate(keys))
    return (keys % BUCKETS).astype(np.int32), np.bincount(keys // BUCKETS, minlength=len(words))


def grams(word: str) -> tuple[int, ...]:
    """Buckets of one word."""
    return tuple(grams_of([word])[0].tolist())


def words_of(text: str | None) -> list[str]:
    """Words; an unbroken run above 64 characters as overlapping pieces of it."""
    words = WORD.findall((text or "").translate(LOWER_TABLE))
    if max(map(len, words), default=0) <= 64:
        return words
    return [p for w in words for p in ([w] if len(w) <= 64 else [w[i:i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]


def starts_of(n: int) -> np.ndarray:
    """First words of the windows that cover a text of ``n`` words."""
    return np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)


class Known(dict):
    """Of each word seen so far, the sum of its subword scalars and, as imaginary part, their number."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def learn(self, words: set[str]) -> None:
        """Make sure that all these words are there."""
        if len(self) > CACHE:
            self.clear()
        new = list(words.difference(self))
        if new:
            flat, many = grams_of(new)
            self.update(zip(new, (np.add.reduceat(self.weights[flat], np.cumsum(many) - many) + 1j * many).tolist()))


class Model:
    """Subword scalars and bias of the log-odds."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, Known(weights)

    def score(self, text: str | None) -> float:
        if not np.isfinite(self.bias):
            return 0.0
        words = words_of(text)
        self.known.learn(set(words))
        return self.score_words(words)

    def score_all(self, texts: Iterable[str | None]) -> list[float]:
        """Scores of many texts, new words of them together."""
        split = [words_of(t) for t in texts]
        self.known.learn(set().union(*split))
        return [self.score_words(w) for w in split] if np.isfinite(self.bias) else [0.0] * len(split)

    def score_words(self, words: list[str]) -> float:
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        total = np.append(0, np.cumsum(np.fromiter(map(self.known.__getitem__, words), dtype=complex, count=len(words))))
        lo = starts_of(len(words))
        hi = np.minimum(lo + WINDOW, len(words))
        span = total[hi] - total[lo]
        return float(1 / (1 + np.exp(-np.clip((span.real / span.imag + self.bias).max(), -50, 50))))


def train(samples: Iterable[str], labels: list[int], rounds: int = 12, seed: int = 7) -> Model:
    """Joint training by Adagrad on all windows of each sample (its words, blank-joined); the worst window of a text and as many clean ones stand for all.

    ``labels`` may grow while the samples are read.
    """
    rng = np.random.default_rng(seed)
    # windows hold word numbers and a word its n-grams once, so memory grows with the windows and not with their n-grams
    number, flat, ends, rows = {}, array("i"), array("q", [0]), []
    seen = np.zeros((2, BUCKETS))
    for i, sample in enumerate(samples):
        words = sample.split(" ") if sample else []
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            parts, many = grams_of(new)
            number.update(zip(new, range(len(number), len(number) + len(new))))
            ends.extend((ends[-1] + np.cumsum(many)).tolist())
            flat.frombytes(parts.tobytes())
        ids = np.array([number[w] for w in words] + [-1] * WINDOW, dtype=np.int32)
        rows.append(ids[starts_of(len(words))[:, None] + np.arange(WINDOW)] if words else np.zeros((0, WINDOW), dtype=np.int32))
        mine = set()
        for x in set(ids.tolist()) - {-1}:
            mine.update(flat[ends[x]:ends[x + 1]])
        seen[int(labels[i]), list(mine)] += 1
    labels = np.array(labels)
    if len(set(labels.tolist())) < 2 or not number:
        return Model(np.zeros(BUCKETS), -np.inf)
    windows, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    del number, rows
    y = labels[owner].astype(float)
    flat, ends = np.frombuffer(flat, dtype=np.int32), np.frombuffer(ends, dtype=np.int64)
    firsts = ends[:-1]
    many = np.append(np.diff(ends), 0)  # the last one stands for the padding
    size = many[windows].sum(axis=1)
    # embeddings start from the log-odds of documents that hold the n-gram, along one direction, plus noise
    total = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())])
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    odds[(seen.sum(axis=0) < 3)] = 0
    emb = rng.normal(0, 0.01, (BUCKETS, DIM))
    layer = np.full(DIM, 1 / np.sqrt(DIM))
    emb += odds[:, None] * layer
    bias, g_emb, g_layer, g_bias = -1.0, np.full(BUCKETS, 1e-3), 1e-3, 1e-3
    layer = layer * 2
    for r in range(rounds):
        per_word = np.append(np.add.reduceat((emb @ layer)[flat], firsts), 0.0)
        logits = per_word[windows].sum(axis=1) / size + bias
        worst = pd.Series(logits).groupby(owner).idxmax().to_numpy()
        extra = rng.choice(np.nonzero(y == 0)[0], min(len(worst), int((y == 0).sum())), replace=False)
        chosen = rng.permutation(np.unique(np.concatenate([worst, extra])))
        weight = np.where(y == 1, min(10.0, (y[worst] == 0).sum() / max(1, (y[worst] == 1).sum())) ** 0.5, 1.0)
        for lo in range(0, len(chosen), 64):
            batch = chosen[lo:lo + 64]
            idx = np.concatenate([flat[ends[x]:ends[x + 1]] for b in batch for x in windows[b] if x >= 0])
            at = np.repeat(np.arange(len(batch)), size[batch])
            mean = np.zeros((len(batch), DIM))
            np.add.at(mean, at, emb[idx] / size[batch][at][:, None])
            err = (1 / (1 + np.exp(-np.clip(mean @ layer + bias, -50, 50))) - y[batch]) * weight[batch]
            grad = (err / size[batch])[at][:, None] * layer
            gl, gb = err @ mean / len(batch) + 1e-4 * layer, err.mean()
            np.add.at(g_emb, idx, (grad ** 2).mean(axis=1))
            np.add.at(emb, idx, -0.2 * grad / np.sqrt(g_emb[idx])[:, None])
            g_layer, g_bias = g_layer + (gl ** 2).mean(), g_bias + gb ** 2
            layer -= 0.1 * gl / np.sqrt(g_layer)
            bias -= 0.1 * gb / np.sqrt(g_bias)
    return Model(emb @ layer, float(bias))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, max_rows: int = 4000) -> Model:
    """Train on labelled rows outside the held-out fold; each class gets up to half of ``max_rows``."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(words_of(t)) for t in texts], dtype=object)

    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids alone are joined and ranked; at most ``max_rows`` of them are broadcast and fetch their texts in one scan for both classes
    ids = docs.where(crc_rest(F.col("doc_id"), modulus) != 0).select("doc_id").distinct().join(known, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    first = ids.withColumn("_n", F.row_number().over(Window.partitionBy("toxic").orderBy("_h", "doc_id"))).where(F.col("_n") <= max_rows // 2).drop("_n")
    rows = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("toxic", "_h", "doc_id", cut("text").alias("words"))
    rows = rows.groupBy("toxic", "_h", "doc_id").agg(F.min("words").alias("words")).repartition(1).sortWithinPartitions("toxic", "_h", "doc_id")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ys = []

        def samples() -> Iterator[str]:
            for f in frames:
                for y, words in zip(f["toxic"], f["words"]):
                    ys.append(y)
                    yield words

        model = train(samples(), ys)
        yield pd.DataFrame({"weights": [model.weights], "bias": [model.bias]})

    with settings(docs.sparkSession, BATCHES):
        found = rows.mapInPandas(learn, "weights ARRAY<DOUBLE>, bias DOUBLE").head()
    return Model(np.array(found["weights"]), found["bias"]) if found else Model(np.zeros(BUCKETS), -np.inf)


def scores(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Model(*shared.value)
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([x for lo in range(0, len(texts), TOGETHER) for x in one.score_all(texts[lo:lo + TOGETHER])], dtype=float)

    return docs.withColumn(out, run(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below one half, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return scores(rows, fit(docs, labels)).where("score < 0.5").select("_row.*")
