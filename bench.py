"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.session import local_session  # noqa: E402
from registry.all import QUERIES  # noqa: E402

HEADLINE = (
    "normalize",
    "normalize_full",
    "chunk",
    "chunk_spans",
    "polarity",
    "emotions",
    "video_sentiment",
    "sentiment_timeline",
    "chunk_explorer",
    "ctfidf",
    "representative_docs",
    "topic_distances",
    "topics_over_time",
    "coherence_npmi",
    "embed_hashed",
    "knn",
    "topic_probs",
    "cluster_density",
    "keyphrases",
    "keywords_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that the start of the session is not counted.
    QUERIES["first_n"](spark, sf_dir).collect()
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
