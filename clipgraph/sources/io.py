"""Sources and sinks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipgraph.functions import arrays as A

# fixed values: sensors, axes and stream rates of the recordings
SENSORS = ["right_arm", "right_leg", "left_leg", "left_arm"]
AXES = ["x", "y", "z"]
SAMPLE_RATE = 50
FRAME_RATE = 30

# fixed values: class names in id order, 0 is the null class
CLASS_NAMES = [
    "null",
    "jogging", "jogging (rotating arms)", "jogging (skipping)", "jogging (sidesteps)", "jogging (butt-kicks)",
    "stretching (triceps)", "stretching (lunging)", "stretching (shoulders)", "stretching (hamstrings)",
    "stretching (lumbar rotation)",
    "push-ups", "push-ups (complex)", "sit-ups", "sit-ups (complex)", "burpees", "lunges", "lunges (complex)",
    "bench-dips",
]


def class_table(spark: SparkSession, names: Sequence[str] = tuple(CLASS_NAMES)) -> DataFrame:
    """The class dimension (label, name)."""
    return spark.createDataFrame(list(enumerate(names)), "label int, name string")


def samples_schema(sensors: Sequence[str], axes: Sequence[str]) -> T.StructType:
    fields = [T.StructField(f"{s}_acc_{a}", T.FloatType()) for s in sensors for a in axes]
    return T.StructType([*fields, T.StructField("label", T.StringType())])


def read_samples(spark: SparkSession, path: str, sensors: Sequence[str] = tuple(SENSORS),
                 axes: Sequence[str] = tuple(AXES), label_map: dict[str, int] | None = None,
                 file_columns: Sequence[str] | None = None, default: int = 0) -> DataFrame:
    """Sensor CSVs with an explicit schema; unknown and missing labels get the default class.

    Adds rec, grp and the sample index ``idx`` in file order. A recording is one file and Spark numbers rows in file
    order inside ascending splits, so the index comes from (file, byte block, row) and needs no sort of the data.
    """
    from clipgraph.operators.filters import map_values
    from clipgraph.operators.ordered import with_row_index

    wanted = samples_schema(sensors, axes)
    names = list(file_columns) if file_columns else wanted.names
    types = {f.name: f for f in wanted.fields}
    schema = T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in names])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    raw = raw.select(*wanted.names, F.col("_metadata.file_name").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    keyed = with_recording_key(raw, "_file")
    mapping = label_map or {n: i for i, n in enumerate(CLASS_NAMES)}
    mapped = map_values(keyed, "label", mapping, default, "label")
    return with_row_index(mapped, "rec", ["_block", "_row"], out="idx").drop("_file", "_block", "_row")


def with_recording_key(df: DataFrame, name: str = "_file") -> DataFrame:
    """rec and grp from a file name such as sbj_14_2.csv: recording sbj_14_2 of participant 14."""
    stem = F.regexp_extract(F.col(name), r"([^/]+?)(\.[^./]*)?$", 1)
    return df.withColumn("rec", stem).withColumn("grp", F.regexp_extract(stem, r"_(\d+)", 1).cast("int"))


def participant_of(rec: str) -> str:
    """SQL text: the participant number of a recording name."""
    return f"CAST(regexp_extract({rec}, '_([0-9]+)', 1) AS INT)"


def sensor_long(samples: DataFrame, sensors: Sequence[str] = tuple(SENSORS), axes: Sequence[str] = tuple(AXES),
                keep: Sequence[str] = ("rec", "grp", "idx", "label")) -> DataFrame:
    """Wide sensor columns to one row per sample and sensor."""
    structs = ", ".join("named_struct('sensor', '" + s + "', " + ", ".join(
        f"'{a}', CAST({s}_acc_{a} AS DOUBLE)" for a in axes) + ")" for s in sensors)
    return samples.select(*keep, F.expr(f"inline(array({structs}))"))


def read_clips(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_embeddings(spark: SparkSession, path: str, key: str = "clip_id", emb: str = "emb", out: str = "f",
                    extra: Sequence[str] = ()) -> DataFrame:
    """Key and vector of a Parquet table, as doubles."""
    return spark.read.parquet(path).select(key, *extra, F.expr(A.to_double(emb)).alias(out))


def read_trajectory(spark: SparkSession, path: str, columns: Sequence[str], time: str = "tracking_timestamp_us",
                    nanos: str | None = None) -> DataFrame:
    """Selected columns of a long trajectory CSV; a nanosecond time column is turned into microseconds ``t_us``."""
    # the header line only: types are fixed below, data is not scanned for inference
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.LongType() if c in (time, nanos) else T.DoubleType()) for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    t = (F.col(nanos) / 1000).cast("long") if nanos else F.col(time)
    return df.select(*columns, t.alias("t_us"))


def write_predictions(df: DataFrame, path: str, ident: str = "id", pred: str = "pred") -> None:
    df.select(F.col(ident).alias("id"), F.col(pred).cast("int").alias("target_feature")) \
      .write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Nested results as JSON lines."""
    df.write.mode("overwrite").json(path)


def nested_summary(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One JSON document {key: {value: number}} per table of results."""
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*values).alias("value"))
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("summary"))


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once: an output with a success marker is read back instead of computed again."""
    spark = df.sparkSession
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
