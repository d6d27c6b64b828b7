"""Compare registered queries with their SQL on a folder of tables: ``python -m clipgraph.registry.check [dir] [names]``."""
from __future__ import annotations

import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("clipgraph")
             .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    got = df.toPandas()
    rel = con.sql(sql)
    want = rel.fetchall()
    cols = sorted(got.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} != {sorted(rel.columns)}"
    rows_a = sorted((tuple(normal(v) for v in row) for row in got[cols].astype(object).where(got[cols].notna(), None)
                     .itertuples(index=False, name=None)), key=repr)
    pos = [rel.columns.index(c) for c in cols]
    rows_b = sorted((tuple(normal(row[i]) for i in pos) for row in want), key=repr)
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} != {len(rows_b)}"
    bad = [(a, b) for a, b in zip(rows_a, rows_b) if a != b]
    return f"{len(bad)} of {len(rows_a)} rows differ, first {cols}: {bad[0]}" if bad else None


def main() -> int:
    import duckdb

    from clipgraph import registry

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pick = sys.argv[2:]
    spark = session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    queries, sql = registry.load()
    failed = 0
    for name, fn in queries.items():
        if pick and not any(p in name for p in pick):
            continue
        t = time.perf_counter()
        try:
            df = fn(spark, d)
            if name in sql:
                note = compare(df, con, sql[name])
                note = "ok" if note is None else f"DIFF {note}"
            else:
                note = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = f"FAIL {type(e).__name__} {str(e)[:int(os.environ.get('CHECK_CHARS', '500'))]}"
        failed += note.startswith(("DIFF", "FAIL"))
        print(f"{name:40s} {time.perf_counter() - t:6.1f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
