"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then twice; the faster run counts.  ``rates`` holds field
"""

from __future__ import annotations

import json
import os
import sys
import time

CPUS = os.environ.get("BENCH_CPUS", "8")
DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

# Words of the batch of 150 queries: one to three of the parts' own words, some misspelt.
WORDS = "red blue green hot cold small large gizmo widget plate ring rod bolt gear anvil gizno smal wigdet".split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from lodestone.engine import SearchEngine
    from lodestone.operators.batch import search_many

    part = spark.read.parquet(f"{DIR}/part.parquet").repartition(int(CPUS)).persist()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").repartition(int(CPUS)).persist()
    n_parts, n_docs = part.count(), docs.count()
    keys = ["p_name", "p_type", "p_brand", "p_size"]

    def parts(**options) -> SearchEngine:
        return SearchEngine(part, ref_index="p_partkey", keys=keys, include_score=True, **options)

    def texts(**options) -> SearchEngine:
        return SearchEngine(docs, ref_index="doc_id", keys=["text"], include_score=True, **options)

    asked = [" ".join(WORDS[(k * 7 + j * 5) % len(WORDS)] for j in range(1 + k % 3)) for k in range(150)]
    batch = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    single = part.coalesce(1).persist()
    single.count()

    def on_one_partition():
        return SearchEngine(single, ref_index="p_partkey", keys=keys, include_score=True).search("smal wigdet", 10)

    # name: (query, searched values)
    queries = {
        "index_build": (lambda: parts().get_index().fields().agg(F.sum("norm")), 4 * n_parts),
        "native_operators": (lambda: parts(use_extended_search=True).search("^red plate$ | 'gizmo", 10), 4 * n_parts),
        "native_contains_documents": (lambda: texts(threshold=0.0, ignore_location=True).search("the ", 10), n_docs),
        "fuzzy_default": (lambda: parts().search("smal wigdet", 10), 4 * n_parts),
        "fuzzy_default_one_partition": (on_one_partition, 4 * n_parts),
        "fuzzy_ignore_location": (lambda: parts(ignore_location=True, threshold=0.4).search("smal wigdet", 10), 4 * n_parts),
        "fuzzy_documents": (lambda: texts().search("attion thanedble", 10), n_docs),
        "token_any": (lambda: parts(use_token_search=True).search("red gizno", 10), 4 * n_parts),
        "token_all": (lambda: parts(use_token_search=True, token_match="all", threshold=0.3).search("red gizno", 10), 4 * n_parts),
        "token_statistics_documents": (lambda: texts(use_token_search=True).document_frequencies().agg(F.sum("df")), n_docs),
        "logical": (lambda: parts().search({"$and": [{"p_name": "red"}, {"$or": [{"p_type": "promo"}, {"p_brand": "#1"}]}]}, 10), 12 * n_parts),
        "highlights": (lambda: parts(include_matches=True).search("wigdet", 10), 4 * n_parts),
        "batch_150_queries": (lambda: search_many(parts(), batch, 10), 150 * 4 * n_parts),
    }
    took, rates = {}, {}
    for name, (query, values) in queries.items():
        runs = []
        for _ in range(3):
            began = time.time()
            query().collect()
            runs.append(time.time() - began)
        took[name] = round(min(runs[1:]), 3)
        rates[name] = round(values / took[name])
    sf = DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
