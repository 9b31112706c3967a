"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local
cores (default 8).  Every result is computed in full into the no-op sink; the first query is run once
beforehand so that the JVM is warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "token_stats",
    "sentence_stats",
    "masked_text",
    "lexicon_hits",
    "dedupe_keep_first",
    "benchmark_contamination",
    "confound_report",
    "stratified_split",
    "engine_thresholds",
    "mime_roundtrip",
    "page_links",
    "zone_split",
    "final_verdict",
    "class_centroids",
    "embedding_score",
    "modality_fusion",
    "tfidf_weights",
    "doc_verdict",
    "segment_rules",
)


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH", "")]))
    from quillspark.plans import registry
    from quillspark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), "16g", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in (HEADLINE[0], *HEADLINE):
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
