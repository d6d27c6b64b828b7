"""Language identification by compression.

Every language has a zstandard raw-content dictionary: text of that language that a compressor may refer back to. A text is
compressed with each dictionary in turn and belongs to the language that gives the fewest bytes; a margin below
``margin`` of the runner-up's bytes rejects the answer (``rejected``; the best language is still named).

Texts are folded first (lower case, runs of non-letters to one blank) and compressed in blocks of ``BLOCK`` characters whose sizes add
up, so that a long text is measured against the dictionaries to its end and not against its own beginning. Every block counts.

Fitting takes a bounded sample: of each language the ``rows`` distinct texts with the smallest hashes outside the held-out fold,
and of each of them an equal share of ``size`` bytes at a place that its hash names. Nothing else is read from ``lang``. The driver holds
languages x ``size`` bytes, which are broadcast; everything else maps over Arrow batches without an exchange.

A null text or one without a letter is ``und`` with score 0, as is every text when no language was learned. Equal sizes go to
the alphabetically first language with a score of one half or less. Repeated rows are judged each, empty tables give no rows, and columns of the
input are kept; those named like an output are replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.llm.common import crc_rest

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
BLOCK, LEVEL = 2048, 6
#: Weight of a byte in the score: bytes saved are evidence in bits, tempered because neighbouring matches are not independent.
BITS = 2.0


def folded(text: str | None) -> str:
    """Letters in lower case, blanks between them; empty without a letter."""
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip()


class Coders:
    """One compressor a language."""

    def __init__(self, known: dict[str, bytes]):
        import zstandard

        self.names = sorted(known)
        self.tools = []
        for name in self.names:
            words = zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of the folded text under each dictionary."""
        blocks = [text[i:i + BLOCK].encode("utf-8", "surrogatepass") for i in range(0, len(text), BLOCK)]
        return np.array([sum(len(tool.compress(b)) for b in blocks) for tool in self.tools], dtype=float)

    def judge(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        plain = folded(text)
        if not plain or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(plain)
        order = np.argsort(sizes, kind="stable")
        weight = np.exp2(-BITS * np.minimum(sizes - sizes[order[0]], 500))
        narrow = len(sizes) > 1 and sizes[order[1]] - sizes[order[0]] < margin * sizes[order[1]]
        return self.names[order[0]], float(weight[order[0]] / weight.sum()), bool(narrow)


def fit(docs: DataFrame, modulus: int = 5, rows: int = 1024, size: int = 1 << 17) -> dict[str, bytes]:
    """Dictionary content of every language, from at most ``rows`` texts and ``size`` bytes each, rows of the held-out fold left out."""
    share = max(1, size // rows)

    @F.pandas_udf("string")
    def piece(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(texts, places):
            t = folded(t)
            lo = h % max(1, len(t) - share + 1)
            out.append(t[lo:lo + share])
        return pd.Series(out, dtype=object)

    train = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_rest(F.col("doc_id"), modulus) != 0))
    hashed = train.select("lang", "text", F.xxhash64("text").alias("h"))
    # hashes are ranked alone, so that no text is sorted; copies of a text count once
    first = hashed.select("lang", "h").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_n") <= rows)
    chosen = hashed.join(F.broadcast(first.drop("_n")), ["lang", "h"], "left_semi")  # at most ``rows`` hashes a language
    found = chosen.select("lang", "h", piece("text", F.col("h").bitwiseAND(F.lit((1 << 62) - 1))).alias("p")).dropDuplicates(["lang", "h"])
    parts: dict[str, list[str]] = {}
    for r in found.orderBy("lang", "h").collect():
        parts.setdefault(r["lang"], []).append(r["p"])
    return {name: " ".join(p).encode("utf-8", "surrogatepass")[:size] for name, p in parts.items() if any(p)}


def identify(docs: DataFrame, known: dict[str, bytes], margin: float = 0.01) -> DataFrame:
    """Add lang_pred, score and rejected for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("lang_pred STRING, score DOUBLE, rejected BOOLEAN")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = Coders(shared.value)
        for texts in batches:
            yield pd.DataFrame([coders.judge(t, margin) for t in texts], columns=["lang_pred", "score", "rejected"])

    row = docs.select(F.struct(*docs.columns).alias("_row"), run("text").alias("_j"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return row.select(*[F.col(f"_row.{c}").alias(c) for c in kept], "_j.lang_pred", "_j.score", "_j.rejected")
