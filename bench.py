"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and on how many cores."""

from __future__ import annotations

import json
import os
import time

from loomspan.queries import QUERIES
from loomspan.session import local_session

HEADLINE = ["token_exact", "token_regex", "concat_wildcard", "repetition_bounded", "edge_outgoing", "edge_path", "event_promotion", "cascade", "filter_text", "mention_counts"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["token_exact"](spark, sf_dir).count()  # starts the JVM's and the workers' engines
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
