"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or "all").
Each query runs once after one untimed warm-up query; results go to a no-op sink, so every row and column
is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "c2_classify_documents", "g10_classification_stats", "v7_validate", "g14_validation_report", "g3_class_metrics",
    "g5_quadratic_kappa", "g7_auc", "g8_auc_ovo_weighted", "g9_mask_agreement", "g20_ks_exact", "g27_box_dimension",
    "g31_calibre_knudtson", "g35_valid_summary", "j2_merge_zones", "j5_lookup_by_name", "j6_pair_eyes", "w3_scale_by_group_max",
    "w4_path_tortuosity", "w5_inflection_metrics", "w12_sector_counts", "u3_label_components", "d1_stratified_split", "d7_upsert",
    "t1_chunk_fixed", "t3_chunk_sentences", "t4_chunk_recursive", "t5_chunk_semantic", "t9_embed", "t12_search_cosine",
    "t13_ivf_probed", "t14_retrieve", "c3_extract_evidence", "x1_stream_validate",
]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    from annolytics.plans.registry import QUERIES
    from annolytics.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [q for q in wanted.split(",") if q] or HEADLINE
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
