"""The run log: one line per timed run, and the curves drawn from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNLOG_SCHEMA = ("timestamp timestamp, n_rows long, n_columns int, n_queries long, "
                 "max_conditions int, time_seconds double")
# the header-less form of the log: every measure written as a double
CURVE_SCHEMA = "timestamp timestamp, dataset_size double, n_queries double, method double, time_seconds double"


def run_record(spark: SparkSession, n_rows: int, n_columns: int, n_queries: int, max_conditions: int,
               time_seconds: float) -> DataFrame:
    """One finished run as a log line."""
    return spark.createDataFrame(
        [(datetime.now(), n_rows, n_columns, n_queries, max_conditions, time_seconds)], RUNLOG_SCHEMA)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add lines to the log; what is there is neither read nor rewritten."""
    runs.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNLOG_SCHEMA).parquet(path)


def read_runs_csv(spark: SparkSession, path: str, schema: str = CURVE_SCHEMA, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def runtime_curves(runs: DataFrame, size_col: str = "dataset_size", series_col: str = "n_queries",
                   time_col: str = "time_seconds") -> DataFrame:
    """(series, size, seconds) as doubles, sorted by series and size: one
    curve of running time over table size per number of queries."""
    return runs.select(
        F.col(series_col).cast("double").alias("series"), F.col(size_col).cast("double").alias("size"),
        F.col(time_col).cast("double").alias("seconds")).orderBy("series", "size", "seconds")
