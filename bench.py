"""Benchmark of the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one warm-up, then ``$BENCH_RUNS`` timed runs; the
median is reported.  Each run executes the full plan into the ``noop`` sink,
so nothing is collected on the driver.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wardlake.plans import catalog  # noqa: E402
from wardlake.session import get_session  # noqa: E402

HEADLINE = {
    "q4_admin_overview": "admin_overview",
    "q5_service_census": "service_census",
    "q6_search_patients": "search_patients",
    "q11_stay_summary": "stay_summary",
    "m5_discharge_by_patient": "discharge_by_patient_stays",
    "m9_ingest_observations": "ingest_observations_accepted",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    extra = {"spark.driver.memory": os.environ.get("BENCH_MEM", "8g")}
    if os.environ.get("BENCH_EVENTLOG"):  # stage and task times, read offline from a scratch folder
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENTLOG"]})
    shuffle = int(os.environ.get("BENCH_SHUFFLE", str(max(cpus * 2, 8))))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=shuffle, app_name="wardlake-bench",
                        extra=extra)
    times = {}
    for key, name in HEADLINE.items():
        fn = catalog.QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms the JVM and the file cache
                samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
