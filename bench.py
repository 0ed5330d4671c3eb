"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import time

from shiftgrain.plans import registry
from shiftgrain.session import build_session

# The first query also writes the stage tables the others read.
HEADLINE = (
    "I8_shots_onice", "I1_merge_intervals", "I4_active_sets", "I6_stint_measures", "J9_last_faceoff_attempt", "W4_recent_attempts",
    "M1_features", "A1_box_counters", "A3_onice_sums", "A4_season_box", "A6_game_log", "A9_goalie_box", "A13_onice_rates", "A29_blurred_grid",
    "J17_pairs_on_ice", "M7_gram", "M7_ridge", "M12_finishing", "A30_team_accounts", "M17_value_ledger", "M20_count_rows", "M34_swap_accounting",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("shiftgrain-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["S1_projected_scan"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
