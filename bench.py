"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cutloom import plans  # noqa: E402
from cutloom.session import build_session  # noqa: E402

HEADLINE = """lex02_postings lex04_rank vec02_topk vec04_hybrid prv01_masked_search
perf03_report perf06_trend lat01_correlate lat03_distribution
tl02_active tl03_overlaps tl05_snap tl10_blade tl11_ripple_delete tl19_merge kf02_value_at ev01_frame_plan
ch03_arrival ch05_groups ch09_segments ix02_keyframes ix03_decode_window ix06_sample_table ts02_unwrap rng01_merge rng03_pages
gr08_neighbourhood gr10_representations gr13_render_closure gr14_rewire dq01_structure dq02_clip dq04_cycles
lg03_validate lg06_replay_nodes lg11_preflight cf02_pairs cf03_rebase tr01_keys tr02_replays
gc01_plan gc02_budget rel01_best_candidate rel02_match rt02_fallback rt04_quarantine
man01_playlists man03_timeline abr01_throughput aud03_block_energy aud07_mix job05_progress job07_replay dag04_levels dag05_cascade
str04_throughput str07_state""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(plans.all_queries())
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.all_queries()
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the executors before the clock
    took = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds = time.time() - start
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
