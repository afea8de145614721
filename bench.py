"""Headline queries: python bench.py prints one JSON line.

Builds sketches over lineitem and orders, estimates, compares sets, and measures
how long an insertion takes for one large set.  Times are wall clock, Spark
included, after a warm-up of all and one of each.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from setforge.config import GeneralizedHyperLogLog, HyperLogLog, HyperMinHash, MinHash, SetSketch1, SetSketch2
    from setforge.operators import cardinality, joint, sketches
    from setforge.plans import catalog
    from setforge.sources.grids import ids

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "100000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    big = 10_000_000

    def registers(cfg, n: int):
        return lambda: sketches.checksum(sketches.build(cfg, ids(spark, n, 7), "element", []).withColumn("one", F.lit(1)), ["one"]).collect()

    def bulk(cfg, n: int):
        return lambda: sketches.checksum(sketches.bulk(cfg, ids(spark, n, 7), "element", [])[0].withColumn("one", F.lit(1)), ["one"]).collect()

    def estimated(cfg, elements, estimate):
        return lambda: estimate(cfg, sketches.build(cfg, elements(spark, SF_DIR), "x", ["key"]), ["key"]).collect()

    def compared(cfg):
        def run():
            elements = catalog.priority_customers(spark, SF_DIR)
            regs, wanted = sketches.build(cfg, elements, "x", ["key"]), catalog.key_pairs(elements)
            return joint.joint(cfg, regs, "key", wanted).collect()

        return run

    queries = {
        "insert_hll_m4096_1e7": registers(HyperLogLog(4096, 2.0, 48, scheme="marked"), big),
        "insert_ghll_b2_m4096_1e7": registers(GeneralizedHyperLogLog(4096, scheme="marked"), big),
        "insert_setsketch1_b2_m4096_1e7": registers(SetSketch1(4096, 2.0, 62, 20.0, scheme="marked"), big),
        "insert_setsketch2_b2_m4096_1e7": registers(SetSketch2(4096, 2.0, 62, 20.0, scheme="marked"), big),
        "insert_setsketch1_bulk_b2_m4096_1e7": bulk(SetSketch1(4096, 2.0, 62, 20.0, scheme="marked"), big),
        "insert_setsketch2_bulk_b2_m4096_1e7": bulk(SetSketch2(4096, 2.0, 62, 20.0, scheme="marked"), big),
        "insert_hyperminhash_1e7": registers(HyperMinHash(12, scheme="marked"), big),
        "insert_minhash_m4096_1e5": registers(MinHash(4096), 100_000),
        "supplier_parts_ghll_simple": estimated(GeneralizedHyperLogLog(256), catalog.supplier_parts, cardinality.simple),
        "supplier_parts_ghll_ml": estimated(GeneralizedHyperLogLog(256), catalog.supplier_parts, cardinality.ml),
        "segment_orders_setsketch1": estimated(SetSketch1(1024, 2.0, 62, 20.0, scheme="marked"), catalog.segment_orders, cardinality.simple),
        "segment_orders_setsketch2": estimated(SetSketch2(64, scheme="marked"), catalog.segment_orders, cardinality.simple),
        "priority_customers_joint": compared(GeneralizedHyperLogLog(1024)),
        "priority_customers_joint_minhash": compared(MinHash(64)),
    }
    for _ in range(3):  # compilers and workers
        queries["insert_hll_m4096_1e7"]()
    times = {}
    for name, run in queries.items():
        run()
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)
    ns = {k: round(v * 1e9 / (100_000 if k.endswith("1e5") else big), 1) for k, v in times.items() if k.startswith("insert")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "ns_per_element": ns, "cpus": int(CPUS), "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
