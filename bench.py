"""Headline queries: one JSON line with seconds per query. The first run of the session is a warm-up and not counted."""

from __future__ import annotations

import json
import os
import time

from quillframe.queries import catalogue
from quillframe.session import local_session

HEADLINE = [
    "stats.describe", "stats.group_stats", "stats.iqr_report", "stats.correlation", "stats.entropy_report", "stats.mann_whitney", "stats.ks_test",
    "clean.fill_nulls", "clean.remove_outliers", "clean.deduplicate_by", "clean.parse_json_column", "transform.groupby_agg", "transform.pivot",
    "transform.rolling_by_key", "transform.cumulative", "transform.rank", "transform.resample", "feature.aggregation_features", "feature.lag_features",
    "feature.woe_encode", "feature.rank_transform", "nlp.word_frequency", "nlp.tfidf", "nlp.collocations", "nlp.readability_score", "nlp.text_dedup_exact",
    "analysis.numeric_summary", "analysis.data_quality", "analysis.market_basket", "analysis.concentration_analysis", "analysis.regression_quick",
    "viz.box_plot", "viz.density_heatmap", "plans.prepare_cleaning",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalogue()
    queries["stats.shape"][0](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
