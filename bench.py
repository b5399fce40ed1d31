"""Time the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import time

from quire.catalog import QUERIES
from quire.plans.scratch import scratch_scope
from quire.plans.session import local_session

HEADLINE = [
    "block_inventory", "quality_report", "visible_text_stats", "page_titles_two_rules", "sanitized_pages", "link_candidates", "block_text_view",
    "language_profile", "repeated_edge_lines", "page_number_lines", "page_chapter_range_join", "longest_ordinal_chain", "translation_batches",
    "ledger_key_equality", "ledger_exactly_once", "progress_latest", "shelf_sorted", "message_history_duration", "annotation_overlaps",
    "highlight_admission", "natural_sort_rank", "chapter_html", "translation_texts", "localized_images", "rpc_answers", "layout_ledger", "task_transitions", "sustained_failures", "cascade_delete_counts", "event_merge", "provider_fold", "mapped_in_batches", "live_state_stream", "progress_upserts", "script_texts", "published_books",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, cores, "8g")
    queries = dict(QUERIES)
    try:
        from quire.llm.registry import QUERIES as extra
    except ImportError:
        extra = {}
    if extra:
        import corpus_pipeline

        extra = extra | {"pipeline": corpus_pipeline.run}
    names = [*HEADLINE, *extra]
    queries |= extra
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up isn't a query's time
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        with scratch_scope():
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
