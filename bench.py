"""Headline timings: prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("clipgraph-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from clipgraph.operators import constraints, features, graph, knn, probs, subspace, windows
    from clipgraph.plans.refine import refine
    from clipgraph.registry import core
    from clipgraph.session import cut

    emb = cut(core.emb(spark, d))
    prior = cut(knn.anchor_prior(emb, emb, core.N_CLASSES, core.KNN))
    evidence = core.evidence(spark, d)
    edges = cut(knn.knn(emb, "grp", 30))
    samples = core.samples(spark, d)
    labelled = prior.join(core.labels_of(spark, d), "clip_id")
    rows = windows.in_windows(samples, 10, 5)

    jobs = {
        "anchor_prior": lambda: knn.anchor_prior(emb, emb, core.N_CLASSES, core.KNN),
        "knn_mutual": lambda: knn.knn(emb, "grp", 30),
        "propagate_5": lambda: graph.propagate(prior, edges, 0.75, 5),
        "drop_top_components": lambda: subspace.drop_top_pcs(emb, "grp", 30),
        "refined_system": lambda: refine(emb, prior, evidence, drop=30),
        "clip_features": lambda: features.clip_features(rows, ["rec", "start"], 10, bands=((0, 1), (1, 3), (3, 5))),
        "window_labels": lambda: windows.index_windows(samples, 10, 5),
        "tune_tau": lambda: probs.tune_tau(labelled, core.N_CLASSES),
        "count_band": lambda: constraints.count_band(prior.selectExpr("clip_id", "grp", "transform(p, x -> ln(x)) AS l"), "grp", 20, 60, iters=12),
    }
    took = {}
    for name, job in jobs.items():
        t = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(d).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
