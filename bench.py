"""Time the headline queries; prints one JSON line.

``python bench.py --growth N`` instead times scores, ranks and one scenario on a generated panel of N entities by 36 periods.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS warm runs per query
(default 2, after one cold run). Every run reads the raw tables; the result goes to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "p5_keep_last", "p7_pivot", "q1_coverage", "s12_last_known_good", "d8_centered_dev", "z4_drivers", "z10_composite",
    "r1_peer_standing", "r7_kpis", "b10_metrics", "b11_comparison", "n4_edges", "a5_spearman", "x5_scenarios", "t6_report",
    "scale_z", "scale_standing", "scale_n2",
)


def growth(spark, entities: int) -> dict[str, float]:
    from panelscore.defaults import DEFAULT_MODEL, preset
    from panelscore.operators import rank, scenario
    from panelscore.operators import score as scoring
    from panelscore.session import pin, scratch
    from panelscore.sources.synthetic import synthetic_panel

    with scratch(spark):
        panel = pin(synthetic_panel(spark, entities, 1990, 2025, groups=50, partitions=64))
        scores = pin(scoring.score_panel(panel, DEFAULT_MODEL).select("entity", "period", "peer_group", "risk_score"))
        steps = {
            "scores": lambda: scoring.score_panel(panel, DEFAULT_MODEL),
            "peer_standing": lambda: rank.peer_standing(scores),
            "scenario": lambda: scenario.shock_scores(panel, DEFAULT_MODEL, [preset("growth_slowdown")]),
        }
        taken = {}
        for name, step in steps.items():
            start = time.perf_counter()
            step().write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 1)
    return taken


def main() -> None:
    from panelscore.plans import catalogue
    from panelscore.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if sys.argv[1:2] == ["--growth"]:
        print(json.dumps({"entities": int(sys.argv[2]), "periods": 36, "seconds": growth(spark, int(sys.argv[2]))}))
        return spark.stop()
    registered = catalogue.queries()
    wanted = sys.argv[1:] or HEADLINE
    seconds, cold = {}, {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        cold[name] = round(taken[0], 3)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
