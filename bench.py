"""Times the headline queries and prints one line of JSON.

Every query runs once to warm up and then BENCH_RUNS times (1), of which the median counts. Rows go to a sink that discards them, so the
whole result is computed; what a run wrote to the scratch folder is deleted after it. Environment:
BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_ONLY (names, or ``all``).
"""

import json
import os
import statistics
import sys
import time

from tidewire.plans.queries import REGISTRY
from tidewire.session import clear_scratch, local_session

HEADLINE = [
    "last_messages", "relevance_filter", "canonical_records", "record_store", "new_records_by_id",
    "latest_indicators", "portal_rows", "page_links", "page_blocks", "page_text", "alert_blocks",
    "normalize_entities", "article_upsert", "mention_edges", "association_edges",
    "cooccur_person_org", "cooccur_person_loc", "cooccur_org_loc", "cooccur_person_person",
    "cooccur_distinct_reports", "weight_upsert", "alerts_top10", "pair_growth_daily",
    "resolve_names", "hop_expand_1", "top_articles_per_anchor", "article_cards", "evidence_rows",
    "entity_summaries", "stream_enrich",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    taken = time.perf_counter() - start
    clear_scratch(spark)
    return taken


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY", "")
    names = list(REGISTRY) if only == "all" else [n for n in only.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    seconds = {}
    for name in names:
        timed = [run(spark, name, folder) for _ in range(runs + 1)][1:]
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name} {seconds[name]} of {[round(t, 1) for t in timed]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": f"total of the median seconds of {len(names)} queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
