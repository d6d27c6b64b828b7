"""Sensor files read whole: labels mapped, rows numbered in file order over many splits."""
from __future__ import annotations

from clipgraph.sources import io


def test_read_samples_numbers_rows_in_file_order(spark, tmp_path):
    counts = {"sbj_3_2.csv": 2500, "sbj_11_2.csv": 700, "sbj_4_2.csv": 1}
    for name, n in counts.items():
        lines = [f"{i},{-i},{0.5},{'b' if i % 3 == 0 else '' if i % 3 == 1 else 'other'}" for i in range(n)]
        (tmp_path / name).write_text("\n".join(["arm_acc_x,arm_acc_y,arm_acc_z,label", *lines]) + "\n")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4096")
    try:
        got = io.read_samples(spark, str(tmp_path), ["arm"], ["x", "y", "z"], {"b": 7}, default=2)
        rows = got.select("rec", "grp", "idx", "arm_acc_x", "label").collect()
    finally:
        spark.conf.set(setting, before)
    assert {f"{r['rec']}.csv" for r in rows} == set(counts) and len(rows) == sum(counts.values())
    first = min(r["idx"] for r in rows)
    assert all(r["idx"] - first == int(r["arm_acc_x"]) and r["label"] == (7 if int(r["arm_acc_x"]) % 3 == 0 else 2) for r in rows)
    assert {r["grp"] for r in rows} == {3, 11, 4} and first == 0
