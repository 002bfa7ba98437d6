"""Column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.operators.columns import INTEGRAL, numeric_columns

STATE_PARTS = ("n", "total", "mean", "m2", "min", "max", "low", "high")
STATE_SCHEMA = ("table string, col string, n long, total decimal(38,0), mean double, m2 double, min double, max double, low long, high long")
STATS_SCHEMA = "table string, col string, min double, max double, mean double, std double"


def column_stats(tables: dict[str, DataFrame], exclude: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(table, col, min, max, mean, std) of every numeric column, std being
    the sample standard deviation (null for one row). Without tables, or
    without numeric columns, no rows.

    One pass per table: all columns are aggregated together, partially on each
    partition, and only the one-row result is turned on its side.
    """
    parts = []
    for name, df in tables.items():
        cols = numeric_columns(df, exclude)
        if not cols:
            continue
        measures = []
        for i, c in enumerate(cols):
            x = F.col(c)
            measures += [
                F.min(x).cast("double").alias(f"min{i}"),
                F.max(x).cast("double").alias(f"max{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
            ]
        lines = [
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("col"),
                     *[F.col(f"{m}{i}").alias(m) for m in ("min", "max", "mean", "std")])
            for i, c in enumerate(cols)
        ]
        parts.append(df.select(*cols).agg(*measures).select(F.inline(F.array(*lines))))
    if not parts:
        return _nothing(tables, STATS_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def _nothing(tables: dict[str, DataFrame], schema: str) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    return spark.createDataFrame([], schema)


def column_states(tables: dict[str, DataFrame], exclude: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(table, col, n, total, mean, m2, min, max, low, high): what statistics are made of, to be stored and added to.

    States of parts of a table add up (``merge_states``), so appended rows need no second look at the old ones. ``m2`` is
    the sum of squared distances from the mean; ``total``, ``low`` and ``high`` are exact and null
    for double columns, ``min`` and ``max`` doubles.
    """
    parts = []
    for name, df in tables.items():
        cols = numeric_columns(df, exclude)
        if not cols:
            continue
        measures, lines = [], []
        for i, c in enumerate(cols):
            x, whole = F.col(c), isinstance(df.schema[c].dataType, INTEGRAL)
            exact = x.cast("long") if whole else F.lit(None).cast("long")
            measures += [F.count(x).alias(f"n{i}"), F.sum(exact.cast("decimal(38,0)")).alias(f"total{i}"), F.avg(x).alias(f"mean{i}"),
                         (F.var_pop(x) * F.count(x)).alias(f"m2{i}"), F.min(x).cast("double").alias(f"min{i}"),
                         F.max(x).cast("double").alias(f"max{i}"), F.min(exact).alias(f"low{i}"), F.max(exact).alias(f"high{i}")]
            lines.append(F.struct(F.lit(name).alias("table"), F.lit(c).alias("col"), *[F.col(f"{m}{i}").alias(m) for m in STATE_PARTS]))
        parts.append(df.select(*cols).agg(*measures).select(F.inline(F.array(*lines))))
    return reduce(DataFrame.unionByName, parts) if parts else _nothing(tables, STATE_SCHEMA)


def merge_states(states: DataFrame) -> DataFrame:
    """One state per (table, col) from any number of them; empty parts add nothing.

    The means are weighted by count and each part's distance from the whole mean is added to ``m2``; the parts are taken in order of
    their values, so the result does not depend on the layout.
    """
    some = F.filter("parts", lambda p: p["n"] > 0)
    n = F.aggregate(some, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    zero = F.lit(0.0).cast("double")
    gathered = (states.groupBy("table", "col").agg(
        F.sort_array(F.collect_list(F.struct("mean", "n", "m2"))).alias("parts"), F.sum("total").alias("total"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("n", n)
        .withColumn("mean", F.when(F.col("n") > 0, F.aggregate(some, zero, lambda a, p: a + p["mean"] * (p["n"] / F.col("n"))))))
    apart = F.aggregate(some, zero, lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return gathered.withColumn("m2", F.when(F.col("n") > 0, apart)).select("table", "col", *STATE_PARTS)


def stats_of(states: DataFrame) -> DataFrame:
    """(table, col, min, max, mean, std, low, high) of merged states; the mean of an integral column comes from its exact total."""
    mean: Column = F.coalesce(F.col("total").cast("double") / F.col("n"), F.col("mean"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return states.select("table", "col", "min", "max", mean.alias("mean"), std.alias("std"), "low", "high")
