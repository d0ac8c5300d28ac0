"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to Spark's no-op sink, so all rows are computed and none collected.
One untimed run of the flagship query first starts the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chunkloom.plans.queries import REGISTRY  # noqa: E402
from chunkloom.session import build_session  # noqa: E402

HEADLINE = [
    "load_corpus", "page_document", "import_status", "chunk_records", "chunk_flat", "chunk_sentence",
    "chunk_markdown", "embed_hash", "list_documents", "sync_plan", "sync_result", "document_catalog",
    "upsert_documents", "knn_cosine", "search_vector", "search_rerank", "knn_ivf", "rebuild_result",
    "stream_ingest", "stream_tumbling",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["search_vector"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
