"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run from scratch: shared closures are forgotten before each. Results are written to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from termweave import plans  # noqa: E402
from termweave.plans import derived  # noqa: E402

HEADLINE = (
    "ont_closure_counts", "ont_deep_closure_counts", "ont_slim_map", "ont_search_labels",
    "assoc_inferred", "assoc_boolean_query", "assoc_enrichment_greater", "assoc_similarity_matrix", "assoc_intersections",
    "sim_ic", "sim_mica", "sim_jaccard", "lex_pairs", "lex_reciprocal", "facet_counts", "search_filter",
    "parse_tsv_lines", "rules_results", "differ_anti", "collapse_annotations", "triples_emit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    plans.QUERIES["facet_pivot"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's classes
    took = {}
    for name in names:
        derived.forget()
        begin = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
