"""Time of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["q_region_grp", "q_junctions", "q_batch", "q_jset", "q_events", "q_splice_paths", "q_cooccur", "gq_tally", "gq_summarize", "x_support", "q_apa", "q_discover", "rp_assign", "rp_collapse", "ann_compare", "coh_events", "q_apa_test"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from moltide.plans.catalogue import QUERIES

    QUERIES["src_archive"](spark, sf_dir).collect()  # stores the evidence, which the timed queries read, and starts the JVM's compiler
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
