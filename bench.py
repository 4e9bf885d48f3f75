"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
BENCH_ONLY, a comma list of name parts, restricts the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = """a9_extension_stats a4_gate_stats a2_duplicates a21_profile_orders j20_revenue_per_customer j9_similar_pairs rt1_question_search
rt1_semantic_search rt4_fused_search w2_rank_fusion rt2_bm25 g2_tfidf g1_graph_edges g5_pagerank g6_shortest_paths c1_html_to_markdown
c25_mask_pii c24_pii_counts c48_chunks tm2_topic_terms e1_neighbour_precision e5_silhouette e7_latency a6_stage_status
a8_queue_throughput_all w12_numbered_attempts c22_quality_gates st4_throughput st9_drain_to_index corpus_category_stats""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    from shelfmark.plans.catalog import QUERIES
    from shelfmark.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(text))").collect()
    times: dict[str, float] = {}
    for name in HEADLINE if not only else [n for n in QUERIES if any(n.startswith(p) for p in only)]:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages", "embeddings", "events", "lineitem")}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "rows": rows, "spark": spark.version, "cores": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
