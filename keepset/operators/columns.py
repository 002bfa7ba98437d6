"""Which columns are features, and simple feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepset.functions.guards import double_features
from keepset.functions.vectors import norm_columns

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Types that get column statistics and may appear in generated queries.
PROFILED = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)

KINDS = {"integral": INTEGRAL, "profiled": PROFILED, "any": (T.DataType,)}


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = (),
                    kinds: str = "profiled") -> list[str]:
    """Column names of the given kind, in table order, without ``exclude``.

    ``"integral"``: byte to long. ``"profiled"``: int, long, float, double.
    ``"any"``: every column.
    """
    wanted, left_out = KINDS[kinds], set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, wanted) and f.name not in left_out]


def feature_doubles(df: DataFrame, id_col: str, cols: list[str], on_null: str = "error") -> DataFrame:
    """(id, cols as double); the id is dropped from ``cols`` if listed."""
    cols = [c for c in cols if c != id_col]
    src, features = double_features(df, cols, on_null)
    return src.select(id_col, *[f.alias(c) for f, c in zip(features, cols)])


def feature_arrays(df: DataFrame, id_col: str, cols: list[str], on_null: str = "error") -> DataFrame:
    """(id, features array<double>)."""
    cols = [c for c in cols if c != id_col]
    src, features = double_features(df, cols, on_null)
    return src.select(id_col, F.array(*features).alias("features"))


def nonzero_rows(df: DataFrame, cols: list[str], on_null: str = "error") -> DataFrame:
    """Rows whose feature vector is not the zero vector."""
    src, features = double_features(df, cols, on_null)
    return src.where(norm_columns(features) > 0)


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows in the given order; ties by the other columns, so
    the subset is the same on every run. Each partition passes on its first
    ``n`` rows and one task merges them, so ``n`` is a subset's size, not a
    table's."""
    rest = [f.name for f in df.schema if f.name not in order_by and not isinstance(f.dataType, T.MapType)]
    return df.orderBy(*order_by, *rest).limit(n)
