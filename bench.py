"""Wall time of every registered query, each on its second run. Prints one JSON line.

What several queries share, a fit or tables loaded month by month, is made anew for the timed run of the first of
them, so its time includes the making; the others read it.
"""

from __future__ import annotations

import json
import os
import time

from riskloom.plans.queries import registered
from riskloom.session import local_session, release

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")

MAKE_ANEW = ("rf_scores", "monthly_user_months")


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    seconds = {}
    for name, query in queries.items():
        run(query, spark)  # class loading and code generation
        if name in MAKE_ANEW:
            release(spark)
        seconds[name] = round(run(query, spark), 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
