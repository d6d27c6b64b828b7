"""Shared pieces: columns by position in a fresh frame, word patterns, row keys."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgraph.session import ensure_checkpoint_dir

#: Words between ASCII white space, and words of digits, letters and everything outside ASCII (after lower-casing A-Z).
SPACED = "[^\\x20\\x09-\\x0D]+"
ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same lower-casing for Python strings.
LOWER_TABLE = str.maketrans(UPPER, LOWER)
#: Whole texts go to Python in batches of few bytes: a worker holds a batch several times over.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name), F.lit(""))


def lowered(col: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(col, UPPER, LOWER)


def crc_rest(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def same_key(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of key columns between two aliased frames."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return out


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for a while."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables of one computation as Parquet in the shared checkpoint folder. A superseded table is dropped as soon as nothing reads it.

    ``settings`` hold while a table is written.
    """

    def __init__(self, spark: SparkSession, settings: dict[str, str] | None = None):
        self.spark, self.folder, self.paths = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", {}
        self.settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (settings or {})

    def save(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back; the shuffle files of the job go with its end, since later plans start from the table."""
        path = f"{self.folder}/{len(self.paths)}"
        with settings(self.spark, self.settings):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[t])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
