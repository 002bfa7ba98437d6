"""Point tables: (id, v0 .. v{d-1}), the input of everything geometric."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.functions.guards import check_features, finite, required
from keepset.functions.vectors import nonzero_norm, norm_columns


def dims_of(points: DataFrame) -> list[str]:
    """The vector columns of a point table, in order."""
    found = [c for c in points.columns if c[:1] == "v" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def feature_points(df: DataFrame, id_col: str, cols: list[str], *, keep: list[str] | None = None,
                   on_null: str = "error", cast: bool = True) -> DataFrame:
    """(id, kept columns, v0 ..): the feature columns as doubles. Null features
    are left to ``unit_points`` and ``pca_points`` to reject, once per row."""
    cols = [c for c in cols if c != id_col]
    if not cols:
        raise ValueError("no feature columns")
    src = check_features(df, cols, on_null, cast)
    return src.select(required(src, id_col).alias("id"), *(keep or []),
                      *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])


def unit_points(points: DataFrame, drop_zero: bool = False) -> DataFrame:
    """The points scaled to length 1; zero vectors stay zero, or are dropped.
    A null, NaN or infinite feature shows in the norm and fails the job."""
    dims = dims_of(points)
    raw = [F.col(v) for v in dims]
    fail = F.raise_error(F.lit("null in a feature column, or NaN or infinity")).cast("double")
    normed = points.withColumn("_norm", norm_columns(raw))
    normed = normed.withColumn("_norm", F.when(finite(F.col("_norm")), F.col("_norm")).otherwise(fail))
    if drop_zero:
        normed = normed.where(F.col("_norm") > 0)
    normed = normed.withColumn("_norm", nonzero_norm(F.col("_norm")))
    others = [c for c in points.columns if c not in dims]
    return normed.select(*others, *[(F.col(v) / F.col("_norm")).alias(v) for v in dims])


def pca_points(points: DataFrame, k: int) -> DataFrame:
    """The points on their first ``k`` principal components, ``k`` capped at
    the number of dimensions. Component signs are arbitrary."""
    dims = dims_of(points)
    k = min(k, len(dims))
    assembled = VectorAssembler(inputCols=dims, outputCol="_raw").transform(points)
    model = PCA(k=k, inputCol="_raw", outputCol="_scores").fit(assembled)
    scores = model.transform(assembled).select("id", vector_to_array("_scores").alias("s"))
    return scores.select("id", *[F.get("s", F.lit(i)).alias(f"v{i}") for i in range(k)])


def prepared_points(df: DataFrame, id_col: str, cols: list[str], *, pca_k: int = 0,
                    drop_zero: bool = False, on_null: str = "error", cast: bool = True) -> DataFrame:
    """Features, optional PCA, unit length: what the medoid selectors run on."""
    points = feature_points(df, id_col, cols, on_null=on_null, cast=cast)
    if pca_k > 0:
        points = pca_points(points, pca_k)
    return unit_points(points, drop_zero)




def spread(points: DataFrame) -> DataFrame:
    """Deal the points out when they come from fewer files than there are
    cores; a table of many files is left as it is. Only the list of files is
    looked at, nothing is run."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return points.repartition(cores) if len(points.inputFiles()) < cores else points
