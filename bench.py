"""Headline timings on the driver tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(fn) -> tuple[float, object]:
    start = time.perf_counter()
    out = fn()
    return time.perf_counter() - start, out


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from tallyfold.models.compare import prediction_table
    from tallyfold.models.glad import glad
    from tallyfold.models.probit import feature_prior
    from tallyfold.models.workers import OneCoinWorker, dawid_skene, mace, one_coin
    from tallyfold.operators import annotations as A
    from tallyfold.operators.evaluation import evaluation_report
    from tallyfold.plans import registry
    from tallyfold.plans import views as V
    from tallyfold.plans.prior_models import linear_inputs

    registry.load()
    q = registry.QUERIES
    ann = V.item_annotations(spark, SF_DIR)
    run_all(ann)  # first touch of the files and the JVM

    seconds: dict[str, float] = {}
    for name in ("d04_majority_vote", "c01_join_statistics", "b06_profile_filter", "h07_evaluation_report",
                 "e01_rerank_runs", "f06_tfidf", "f11_bm25_score"):
        seconds[name], _ = timed(lambda n=name: run_all(q[n](spark, SF_DIR)))

    rounds = 10
    fits = {}
    for name, fit in (
        ("ds", lambda: dawid_skene(ann, rounds=rounds, threshold=None)),
        ("zc", lambda: one_coin(ann, rounds=rounds, threshold=None)),
        ("mace", lambda: mace(ann, rounds=rounds)),
        ("glad", lambda: glad(ann, rounds=1, threshold=None, inner_steps=1, step_size=0.5)),
        ("glad_default_round", lambda: glad(ann, rounds=1, threshold=None)),
        ("feature_prior_round", lambda: feature_prior(*linear_inputs(spark, SF_DIR), OneCoinWorker(), rounds=1, threshold=None)),
    ):
        seconds[name], fits[name] = timed(fit)
    acc = {
        name: evaluation_report(prediction_table(f, A.gold_labels(ann))).first()["acc"] for name, f in fits.items()
    }
    total = sum(seconds.values())
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "rounds": rounds,
                "seconds_per_round": {k: round(seconds[k] / rounds, 3) for k in ("ds", "zc", "mace")},
                "accuracy": {k: round(v, 4) for k, v in acc.items()},
                "cpus": int(CPUS),
                "shuffle_partitions": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
