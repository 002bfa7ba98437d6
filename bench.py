"""Headline timings. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS.
The tables are cached first and one small popularity run warms the session up;
then each query is timed once, workload generation included and column
statistics not, as in the published figures. Names on the command line choose
queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keepset.operators import clara, importance, kcenter, medoids, popularity, stats, workload
from keepset.session import recommended

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
FEATURES = ["l_quantity", "l_linenumber", "l_suppkey"]
WIDE = 55


def main() -> None:
    spark = (recommended(SparkSession.builder.master(f"local[{CPUS}]")).appName("keepset-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def prepare(df):
        ready = df.repartition(int(CPUS)).cache()
        return ready, ready.count()

    lineitem, n_rows = prepare(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_orderkey", *FEATURES))
    # a table as wide as the widest published one, its columns hashed from the rows of lineitem
    wide, _ = prepare(spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_orderkey", *[
        F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_extendedprice", F.lit(i)), F.lit(20 + i)).cast("int").alias(f"f{i}")
        for i in range(WIDE)]))
    orders, _ = prepare(spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"))
    wide_cols = [f"f{i}" for i in range(WIDE)]
    line_stats = stats.column_stats({"t": lineitem}, ["l_orderkey"]).cache()
    wide_stats = stats.column_stats({"t": wide}, ["l_orderkey"]).cache()
    line_stats.count(), wide_stats.count()

    def pop(df, st, n, conds):
        made = workload.generate_workload(st, n, conds)
        return popularity.ranked(popularity.popularity(df, made, "l_orderkey")).limit(5).collect()

    def imp(df, st, cols, n, conds=1):
        made = workload.generate_workload(st, n, conds)
        return importance.importance(df, made, cols, "l_orderkey", top=5).collect()

    runs = {
        "column_stats": lambda: stats.column_stats({"l": lineitem, "o": orders}).collect(),
        "pop_100q": lambda: pop(lineitem, line_stats, 100, 1),
        "pop_1000q": lambda: pop(lineitem, line_stats, 1000, 1),
        "pop_10000q": lambda: pop(lineitem, line_stats, 10000, 1),
        "pop_10000q_3conds": lambda: pop(lineitem, line_stats, 10000, 3),
        "pop_100q_55cols": lambda: pop(wide, wide_stats, 100, 1),
        "pop_8000q_5conds_55cols": lambda: pop(wide, wide_stats, 8000, 5),
        "importance_100q": lambda: imp(lineitem, line_stats, FEATURES, 100),
        "importance_10000q": lambda: imp(lineitem, line_stats, FEATURES, 10000),
        "importance_100q_55cols": lambda: imp(wide, wide_stats, wide_cols, 100),
        "importance_sum": lambda: importance.summed_importance(
            lineitem.withColumn("popularity", F.col("l_quantity") / 50), id_col="l_orderkey").agg(F.max("importance")).collect(),
        "medoids_pam_15": lambda: medoids.pam_medoids(lineitem, "l_orderkey", FEATURES, 15).collect(),
        "medoids_clara_15": lambda: clara.clara_medoids(lineitem, "l_orderkey", FEATURES, 15).collect(),
        "kcenter_100": lambda: kcenter.kcenter_medoids(lineitem, "l_orderkey", FEATURES, 100).collect(),
    }
    pop(lineitem.limit(1000), line_stats, 70, 2)  # warm up

    only = sys.argv[1:]
    seconds = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "rows": n_rows}))


if __name__ == "__main__":
    main()
