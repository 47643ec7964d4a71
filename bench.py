"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from partloom import catalog
from partloom.session import get_session

HEADLINE = (
    "cells_by_method",
    "transformed_cells",
    "pivot_to_target",
    "compare_values",
    "reconcile_positions",
    "reconcile_multiset",
    "cv_duplicate_positions",
    "mapping_value_evidence",
    "stats_overview",
    "stats_by_customer",
    "learned_corrections",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench")
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
