"""Input checks that run inside the plan, where the bad value is met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON_NULL = ("error", "drop")


def required(df: DataFrame, name: str, as_type: str | None = None) -> Column:
    """The column, failing the job when a row holds a null in it."""
    kind = as_type or df.schema[name].dataType.simpleString()
    fail = F.raise_error(F.lit(f"null in column {name!r}")).cast(kind)
    return F.coalesce(F.col(name).cast(kind), fail)


def check_features(df: DataFrame, cols: list[str], on_null: str, cast: bool) -> DataFrame:
    """The table the features are to be read from: without its rows that hold
    a null, NaN or infinite feature when ``on_null="drop"``. With ``cast=False`` only columns
    that are numeric already are taken."""
    if on_null not in ON_NULL:
        raise ValueError(f"on_null must be one of {ON_NULL}, not {on_null!r}")
    if not cast:
        text = [c for c in cols if not isinstance(df.schema[c].dataType, T.NumericType)]
        if text:
            raise TypeError(f"not numeric and cast=False: {text}")
    if on_null == "error":
        return df
    return df.where(reduce(lambda a, b: a & b, [_usable(df, c) for c in cols], F.lit(True)))


def _usable(df: DataFrame, name: str) -> Column:
    """Neither null nor, in a column that can hold them, NaN or infinite."""
    x = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return x.isNotNull() & finite(x)
    return x.isNotNull()


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def double_features(df: DataFrame, cols: list[str], on_null: str = "error",
                    cast: bool = True) -> tuple[DataFrame, list[Column]]:
    """Feature expressions as doubles and the table they are read from; with
    ``on_null="error"`` the job fails at the first null, NaN or infinite one."""
    src = check_features(df, cols, on_null, cast)
    if on_null == "drop":
        return src, [F.col(c).cast("double") for c in cols]
    fail = F.raise_error(F.lit("a feature is NaN or infinite")).cast("double")
    return src, [F.when(finite(x), x).otherwise(fail) for x in (required(df, c, "double") for c in cols)]
