"""Wall-clock of the headline queries; prints one JSON line.

``fit_*`` is the training of one model alone, on the stored satisfaction table.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import REGISTRY, plan  # noqa: E402
from checks.session import cleaned_sessions, ensure_scratch  # noqa: E402
from usagelens.operators import models  # noqa: E402
from usagelens.workspace import drop_scratch  # noqa: E402

HEADLINE = ["load_sessions", "clean_sessions", "user_overview", "user_engagement",
            "user_app_traffic", "user_experience", "top_handsets_per_manufacturer",
            "basic_metrics", "correlation_matrix", "decile_segmentation", "histogram",
            "pca_explained", "top10_per_metric", "top10_per_app", "engagement_clusters",
            "engagement_clusters_ml", "elbow_curve", "experience_clusters", "experience_boxes",
            "satisfaction_table", "satisfaction_labels", "train_ridge", "ridge_cv", "train_rf",
            "train_gbt"]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{directory}/lineitem.parquet").count()  # start the executors
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    ensure_scratch(spark)
    start = time.perf_counter()
    cleaned_sessions(spark, directory).count()
    seconds["stored_cleaned_sessions"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].frame(spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    if names is HEADLINE:
        table = plan(spark, directory).satisfaction
        for name in models.CANDIDATES:
            record = models.train(table, name, key="user_id", with_cv=False)[1].first()
            seconds[f"fit_{name}"] = round(record.train_duration_sec, 3)
    print(json.dumps({"metric": "headline queries, total wall-clock",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(directory).name}))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
