"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line of wall-clock seconds."""

import json
import os
import sys
import time

from kolumna.queries import all_queries
from kolumna.session import get_session

NAMES = (
    "select_by_agg where_refine topk_sort_limit update_by agg_moments agg_pairs count_distinct top_n_per_group xgroup_ungroup pivot_linestatus lj_first_match ej_pairs"
    " uj_keyed semi_join aj_events wj1_events running moving rank_functions xbar_time_bucket regex_extract_all json_props list_verbs graph_triangles knn_cosine"
).split()
#: Iterative queries and searches; not part of the sum, so that it stays comparable.
MORE = "graph_components graph_dijkstra graph_pagerank datalog_closure aj_bucketed ema_events bin_search xasc_parts multiway_cycle knn_many ann_hashed".split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = get_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    known, seconds = all_queries(), {}
    for name in NAMES + MORE:
        run = lambda: known[name](spark, folder).write.format("noop").mode("overwrite").save()  # noqa: E731, B023
        run()  # compiles
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 4)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(seconds[n] for n in NAMES), 4), "unit": "sec", "queries": {n: seconds[n] for n in NAMES}, "more": {n: seconds[n] for n in MORE}, "sf": os.path.basename(folder.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
