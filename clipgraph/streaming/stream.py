"""Structured Streaming forms of the clip operators. Each also runs on a static table and then gives the same rows."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clipgraph.functions import arrays as A

E = A.E


def window_features(value: str, x: str) -> dict[str, str]:
    """SQL text per feature of an ordered array column ``x``. Windows hold a bounded number of samples."""
    n = f"size({x})"
    mean = f"{A.vsum(x)} / {n}"
    central = lambda k: A.let(mean, lambda m: f"{A.fold(x, lambda s, v: f'{s} + pow({v} - {m}, {k})')} / {n}")
    diffs = f"zip_with(slice({x}, 2, greatest({n} - 1, 0)), slice({x}, 1, greatest({n} - 1, 0)), (a, b) -> abs(a - b))"
    signs = A.let(mean, lambda m: A.each(x, lambda v: f"signum({v} - {m})"))
    flips = A.let(signs, lambda s: f"zip_with(slice({s}, 2, greatest({n} - 1, 0)), slice({s}, 1, greatest({n} - 1, 0)), "
                                   f"(a, b) -> IF(a <> b, 1D, 0D))")
    return {
        f"n_{value}": n, f"mean_{value}": mean, f"std_{value}": f"sqrt({central(2)})", f"min_{value}": f"array_min({x})",
        f"max_{value}": f"array_max({x})", f"rms_{value}": f"sqrt({A.dot(x, x)} / {n})",
        f"skew_{value}": f"{central(3)} / pow(sqrt({central(2)}) + 1e-6D, 3)",
        f"kurt_{value}": f"{central(4)} / pow(sqrt({central(2)}) + 1e-6D, 4)",
        f"absdiff_{value}": f"IF({n} > 1, {A.vsum(diffs)} / ({n} - 1), NULL)",
        f"zcr_{value}": f"IF({n} > 1, {A.vsum(flips)} / ({n} - 1), NULL)",
    }


def stream_windows(df: DataFrame, width: str, slide: str | None, lateness: str, by: Sequence[str] = ("rec",),
                   ts: str = "ts", value: str = "x", label: str | None = "label", ident: str = "event_id") -> DataFrame:
    """Tumbling or sliding event-time windows with features and the majority label (smallest on ties).

    Samples of one window and group are kept as an ordered array; rows later than the watermark are dropped.
    """
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    packed = F.struct(F.col(ts).alias("t"), F.col(ident).alias("i"), F.col(value).cast("double").alias("x"),
                      *([F.col(label).alias("l")] if label else []))
    g = df.withWatermark(ts, lateness).groupBy(win.alias("w"), *by).agg(F.array_sort(F.collect_list(packed)).alias("_p"))
    rows = g.withColumn("_x", E(A.each("_p", lambda p: f"{p}.x")))
    cols = [E(t).alias(n) for n, t in window_features(value, "_x").items()]
    if label:
        tally = A.let(f"transform(array_distinct(transform(_p, e -> e.l)), l -> struct(-size(filter(_p, e -> e.l = l)) AS c, l AS l))",
                      lambda t: f"array_min({t}).l")
        cols.append(E(tally).alias("label"))
    return rows.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *cols)


def stream_sessions(df: DataFrame, gap: str, lateness: str, by: Sequence[str] = ("rec",), ts: str = "ts") -> DataFrame:
    """Runs split at gaps: (group, start, end, n)."""
    g = df.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_enrich(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream-static left join with a dimension or a learned basis."""
    return df.join(dim, list(on), "left")


class PartRefiner:
    """Runs a batch operator once on every part of the time line, when the part is closed.

    A part holds the rows whose event time falls into one interval of ``width_us`` microseconds; it closes when the latest time seen, less
    ``late_us``, has passed its end. Rows wait for that in a table beside the checkpoint, one folder per micro-batch: a part of any size lies spread
    over files and tasks, not in one key's state. Rows of closed parts are late and dropped, as a watermark does. Every folder belongs to one
    micro-batch and is written as a whole, so a retried batch changes nothing, and the results do not depend on how the rows were cut into batches.
    ``finish`` closes what is open when the stream has ended.
    """

    def __init__(self, refine: Callable[[DataFrame], DataFrame], folder: str, width_us: int, late_us: int, ts: str = "ts", part: str = "part"):
        self.refine, self.folder, self.width, self.late, self.ts, self.part = refine, folder, width_us, late_us, ts, part

    def _closed(self, spark: SparkSession, before: int) -> int | None:
        """The time up to which parts were closed before micro-batch ``before``."""
        marks = spark.read.schema("epoch LONG, until LONG").parquet(f"{self.folder}/marks")
        return marks.where(F.col("epoch") < before).agg(F.max("until")).head()[0]

    def _emit(self, spark: SparkSession, lo: int | None, hi: int | None, epoch: int) -> None:
        end = (F.col(self.part) + 1) * self.width
        rows = spark.read.schema(self.schema).parquet(f"{self.folder}/rows")
        done = rows.where((F.lit(True) if lo is None else end > lo) & (F.lit(True) if hi is None else end <= hi))
        self.refine(done).write.mode("overwrite").parquet(f"{self.folder}/refined/batch={epoch}")

    def begin(self, spark: SparkSession) -> None:
        """Empty tables of marks and rows; a stream without rows never fills them."""
        spark.createDataFrame([(-1, None)], "epoch LONG, until LONG").write.mode("overwrite").parquet(f"{self.folder}/marks/of=-1")
        spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/rows/of=-1")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        rows = batch.withColumn(self.part, F.floor(us / self.width).cast("long"))
        self.schema = rows.schema
        if epoch == 0:
            self.begin(spark)
        before = self._closed(spark, epoch)
        if before is not None:
            rows = rows.where((F.col(self.part) + 1) * self.width > before)
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/of={epoch}")
        latest = spark.read.schema(self.schema).parquet(f"{self.folder}/rows/of={epoch}").agg(F.max(us)).head()[0]
        until = before if latest is None else max(latest - self.late, before if before is not None else latest - self.late)
        if until is not None:
            self._emit(spark, before, until, epoch)
        spark.createDataFrame([(epoch, until)], "epoch LONG, until LONG").write.mode("overwrite").parquet(f"{self.folder}/marks/of={epoch}")

    def finish(self, spark: SparkSession, schema: StructType | None = None) -> None:
        """Refine the parts that were still open when the stream ended."""
        if schema is not None:
            self.schema = schema
        self._emit(spark, self._closed(spark, 1 << 62), None, -1)


def stream_refine(df: DataFrame, refiner: PartRefiner, **trigger) -> DataFrame:
    """Feed a stream to a refiner until it ends, close the last parts and return all refined rows."""
    refiner.schema = df.withColumn(refiner.part, F.lit(0).cast("long")).schema
    refiner.begin(df.sparkSession)
    query = df.writeStream.foreachBatch(refiner).option("checkpointLocation", f"{refiner.folder}/log").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    refiner.finish(df.sparkSession)
    return df.sparkSession.read.parquet(f"{refiner.folder}/refined").drop("batch")


#: A stream ends with a row at this time: the watermark passes everything before it.
END_OF_TIME = "9999-01-01 00:00:00"


def with_end(df: DataFrame, folder: str, ts: str = "ts") -> DataFrame:
    """The stream together with closing rows, which ``run_to_end`` puts into ``folder``. They hold nothing but the time, and no window of theirs ever closes."""
    ends = df.sparkSession.readStream.schema(f"{ts} {dict(df.dtypes)[ts]}").parquet(folder)
    return df.unionByName(ends, allowMissingColumns=True)


def run_to_end(make: Callable[[DataFrame], DataFrame], df: DataFrame, folder: str, ts: str = "ts") -> DataFrame:
    """Run an append query over a stream to its end, then once more with a closing row, so that windows and sessions open at the end come out too."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], f"{ts} {dict(df.dtypes)[ts]}")
    empty.write.mode("append").parquet(f"{folder}/ends")

    def drain() -> None:
        out = make(with_end(df, f"{folder}/ends", ts))
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()

    drain()
    empty.unionByName(spark.range(1).select(F.lit(END_OF_TIME).cast(dict(df.dtypes)[ts]).alias(ts))).coalesce(1).write.mode("append").parquet(f"{folder}/ends")
    drain()
    return spark.read.schema(make(df).schema).parquet(f"{folder}/out")


def stream_counts(df: DataFrame, by: Sequence[str] = ("rec",), label: str = "label") -> DataFrame:
    """Running class counts per recording (complete or update output)."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def stream_align(a: DataFrame, b: DataFrame, tolerance: str, lateness: str, by: Sequence[str] = ("rec",),
                 ts: str = "ts", columns: Sequence[str] = ("x",)) -> DataFrame:
    """Inner join of two sensors' rows of the same group whose times differ by at most the tolerance."""
    pick = lambda d, s: d.withWatermark(ts, lateness).select(*[F.col(c).alias(f"{c}_{s}") for c in (*by, ts, *columns)])
    left, right = pick(a, "a"), pick(b, "b")
    cond = E(f"{ts}_b BETWEEN {ts}_a - INTERVAL {tolerance} AND {ts}_a + INTERVAL {tolerance}")
    for c in by:
        cond = cond & (F.col(f"{c}_a") == F.col(f"{c}_b"))
    return left.join(right, cond)
