"""Headline queries, timed. Prints one JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from driftwake.plans import catalog
from driftwake.session import local_session

HEADLINE = ("ais_gaps", "feed_summary", "segment_kinematics", "trust_scores", "speed_reduction_runs", "position_at", "score_terms",
            "best_hypothesis", "wind_fill", "env_sample", "baseline_stats", "baseline_z", "robust_background", "metrics_by_sensor",
            "threshold_sweep", "band_weights", "shore_eta", "tier", "recipients", "detectability", "audit_links", "digest_verify",
            "zonal_stats", "cfar_windows", "sar_ais_match", "envelope_hits", "candidate_rollup", "release_hypotheses", "gap_coincidence",
            "nearest_vessel", "morphology", "polygon_metrics", "polygon_iou", "coast_distance", "posterior_rank")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.range(1_000_000).selectExpr("id % 8 k").groupBy("k").count().collect()  # start the executor threads
    plans, times = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
