"""Session helpers: reliable lineage cuts in the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine and an error on a cluster."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="clipgraph-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so iterative plans neither grow nor recompute."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back: unlike a checkpoint the table carries no facts of its plan along, which add up
    over many rounds."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounds(limit: int | None) -> Iterable[int]:
    """Numbers of rounds, without end when no limit is given."""
    return count() if limit is None else range(limit)


SMALL_BYTES = 128 << 20


def measured_bytes(df: DataFrame) -> int:
    """Rows and array items of a materialised table, at eight bytes an item and sixteen a plain column."""
    flat = 16 * len(df.columns)
    parts = [str(flat)]
    for name, kind in df.dtypes:
        if kind.startswith("array<array"):
            parts.append(f"8L * aggregate(transform(`{name}`, x -> size(x)), 0, (s, x) -> s + x)")
        elif kind.startswith("array<"):
            parts.append(f"8L * size(`{name}`)")
    return int(df.agg(F.expr(f"coalesce(sum({' + '.join(parts)}), 0)").alias("n")).head()[0])


def small_side(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Materialise a per-group table and broadcast it only when its measured size allows.

    The planner cannot know how small an aggregate is and would shuffle the large side first. Beyond the limit the
    table is returned as it is: the join then shuffles and hot keys are split at run time.
    """
    df = cut(df)
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def join_small(df: DataFrame, side: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Attach a per-group table (a single row without keys); ``how="left"`` keeps rows of groups that it does not name, with nulls."""
    if by:
        return df.join(small_side(side), by, how)
    return df.join(F.broadcast(side), F.lit(True), how)


def keys(by: str | Sequence[str] | None) -> list[str]:
    """Normalise a grouping argument to a list of column names."""
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)
