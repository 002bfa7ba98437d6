"""Vector arithmetic in two layouts.

Inside jobs a vector is a run of double columns ``v0 .. v{d-1}``: sums and
products over them are plain arithmetic that Spark compiles. Array columns are
the exchange form, for callers that want one column per vector.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norm given to a zero vector, so that its cosine with anything is 0.
ZERO_NORM = 1e-9

# Similarities are compared in steps of 1e-9. Distributed sums come out a few
# ulps apart from run to run; without steps an exact tie would be decided by
# that noise instead of by the smallest id.
STEPS = 1e9


# -- column layout ---------------------------------------------------------

def add_all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot_columns(a: list[Column], b: list[Column]) -> Column:
    return add_all([x * y for x, y in zip(a, b, strict=True)])


def nonzero_norm(norm: Column) -> Column:
    """The norm to divide by; a zero vector stays zero under it."""
    return F.when(norm == 0, F.lit(ZERO_NORM)).otherwise(norm)


def norm_columns(cols: list[Column]) -> Column:
    return F.sqrt(dot_columns(cols, cols))


def steps(similarity: Column) -> Column:
    """A similarity in whole steps of 1e-9, for comparing."""
    return F.floor(similarity * F.lit(STEPS) + F.lit(0.5))


# -- array layout ----------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    safe = nonzero_norm(l2_norm(v))
    return F.transform(v, lambda x: x / safe)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, 0 when either is a zero vector."""
    both = l2_norm(a) * l2_norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def dissimilarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def add_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)
