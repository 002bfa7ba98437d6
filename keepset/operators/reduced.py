"""The reduced table R': the base rows of the kept ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduced_set(df: DataFrame, kept: DataFrame, id_col: str = "Unique_ID", kept_col: str = "id") -> DataFrame:
    """One base row per kept id.

    A semi-join with the kept ids, then, where an id repeats, its smallest row
    by all columns, so the outcome does not depend on the layout. Rows of one
    id are reduced on each partition before they meet.
    """
    ids = kept.select(F.col(kept_col).alias(id_col))
    rows = df.join(ids, id_col, "left_semi").select(*df.columns)
    others = [c for c in df.columns if c != id_col]
    if not others:
        return rows.distinct()
    smallest = rows.groupBy(id_col).agg(F.min(F.struct(*others)).alias("_row"))
    return smallest.select(*[id_col if c == id_col else F.col(f"_row.{c}").alias(c) for c in df.columns])
