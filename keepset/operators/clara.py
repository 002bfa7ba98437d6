"""k medoids from samples, judged on the whole table.

Every restart draws its own sample of about ``sample_size`` rows; the samples
are clustered side by side, one task each, and one pass over the whole table
gives the cost of all restarts. The medoids of least cost are kept.

What a task holds is bounded by ``sample_size``, not by the data: rows are
drawn one by one, so an id or a repeated row with a large share of the table
gets that share of the sample and no more, and equal rows in a sample are
folded into one with a weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.functions.hashing import hash_key, uniform
from keepset.functions.vectors import STEPS, steps
from keepset.operators.medoids import Medoids, medoid_set, clustering_cost, farthest_point, kept_ids
from keepset.operators.points import dims_of, prepared_points, spread

SAMPLE_ROUNDS = 50
BLOCK = 4096  # rows of a sample multiplied at a time


def clara_samples(points: DataFrame, fraction: float, restarts: int, seed: int = 42,
                  unique_ids: bool = False) -> DataFrame:
    """(restart, id, v0 .., copies): a Bernoulli sample per restart, the same
    on any layout.

    Equal rows are folded into one line first. A line of ``c`` rows is drawn
    by a hash of restart, id and vector (in steps of 1e-9) with probability ``fraction * c``, at
    most 1, and counts for ``fraction * c`` rows, at least 1. ``unique_ids``
    says that no id repeats: nothing is folded then and the hash is of the id.
    """
    dims = dims_of(points)
    if unique_ids:
        lines, parts = points.withColumn("copies", F.lit(1).cast("long")), [F.col("id")]
    else:
        lines = points.groupBy("id", *dims).agg(F.count("*").alias("copies"))
        parts = [F.col("id"), *[steps(F.col(v)) for v in dims]]
    share = F.col("copies") * F.lit(float(fraction))
    taken = F.filter(F.sequence(F.lit(0), F.lit(restarts - 1)), lambda r: uniform(r + seed, *parts) < share)
    drawn = lines.select(F.explode(taken).alias("restart"), "id", *dims, "copies")  # only what is drawn is copied
    return drawn.withColumn("copies", F.greatest(F.lit(1), F.round(share)).cast("long"))


def sample_medoids(samples: DataFrame, k: int, seed: int = 42, max_iter: int = SAMPLE_ROUNDS) -> DataFrame:
    """(restart, cid, id, v0 ..): the medoids of each sample. A sample with
    fewer than ``k`` ids gives as many medoids as it has ids."""
    dims = dims_of(samples)
    kinds = dict(samples.dtypes)
    schema = f"restart int, cid int, id {kinds['id']}, " + ", ".join(f"{v} double" for v in dims)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", *dims], ignore_index=True)
        x, weight = rows[dims].to_numpy(), rows["copies"].to_numpy()
        ids = rows["id"].to_numpy()
        picked = _cluster_sample(x, weight, ids, int(rows["draw"].argmin()), k, max_iter)
        out = rows.loc[picked, ["restart", "id", *dims]].reset_index(drop=True)
        out.insert(1, "cid", np.arange(len(out), dtype=np.int32))
        return out

    drawn = samples.withColumn("draw", hash_key(F.col("restart") + seed, F.col("id")))
    return drawn.groupBy("restart").applyInPandas(cluster, schema)


def _stepped(similarity: np.ndarray) -> np.ndarray:
    return np.floor(similarity * STEPS + 0.5)


def add_farthest(x: np.ndarray, ids: np.ndarray, picked: list[int], k: int) -> list[int]:
    """Grow ``picked`` to ``k`` rows of different ids, farthest first."""
    picked = list(picked)
    best = (x @ x[picked].T).max(axis=1)
    closed = np.isin(ids, ids[picked])
    while len(picked) < k and not closed.all():
        at = int(np.where(closed, np.inf, _stepped(best)).argmin())
        picked.append(at)
        closed |= ids == ids[at]
        best = np.maximum(best, x @ x[at])
    return picked


def _cluster_sample(x: np.ndarray, weight: np.ndarray, ids: np.ndarray, first: int, k: int,
                    max_iter: int) -> list[int]:
    """Rows of the medoids of one sample: farthest-point seeds, then
    assignment and best member in turn until nothing moves."""
    picked = add_farthest(x, ids, [first], k)
    for _ in range(max_iter):
        near = np.concatenate([_stepped(x[at:at + BLOCK] @ x[picked].T).argmax(axis=1) for at in range(0, len(x), BLOCK)])
        moved = [-1] * len(picked)
        for c in range(len(picked)):
            member = np.flatnonzero(near == c)
            if len(member):
                mean = (x[member] * weight[member, None]).sum(axis=0) / weight[member].sum()
                moved[c] = int(member[_stepped(x[member] @ mean).argmax()])
        if -1 in moved:
            full = [m for m in moved if m >= 0]
            spare = iter(add_farthest(x, ids, full, len(picked))[len(full):])
            moved = [m if m >= 0 else next(spare) for m in moved]
        if moved == picked:
            break
        picked = moved
    return picked


def clara(points: DataFrame, k: int, sample_size: int = 20000, restarts: int = 8, seed: int = 42,
          unique_ids: bool = False) -> Medoids:
    """The medoid set of least total cost among the restarts, the first on
    ties. A set short of ``k`` (its sample had fewer ids) is completed with
    the farthest points of the whole table."""
    if k <= 0:
        raise ValueError("the number of rows to keep must be positive")
    dims, n = dims_of(points), points.count()
    if n == 0:
        return Medoids([], np.zeros((0, len(dims))))
    if k > n:
        raise ValueError(f"{k} rows are to be kept, but there are only {n}")
    # a sample must be able to hold k medoids
    fraction = min(1.0, max(sample_size, 2 * k) / n)
    found = sample_medoids(clara_samples(points, fraction, restarts, seed, unique_ids), k, seed)
    rows = found.orderBy("restart", "cid").collect()  # k rows per restart
    sets = [medoid_set([r for r in rows if r["restart"] == s], dims)
            for s in sorted({r["restart"] for r in rows})]
    if not sets:
        return farthest_point(points, k, seed)
    costs = {r["restart"]: r["cost"] for r in clustering_cost(points, [m.vectors for m in sets]).collect()}
    best = sets[min(costs, key=lambda r: (costs[r], r))]
    return best if len(best) == k else farthest_point(points, k, start=best)


def clara_medoids(df: DataFrame, id_col: str, numeric_cols: list[str], t_keep: int, *,
                  sample_size: int = 20000, restarts: int = 8, pca_k: int = 0, seed: int = 42,
                  unique_ids: bool = False, on_null: str = "error",
                  cast_features_to_double: bool = True) -> DataFrame:
    """(cid, id) of ``t_keep`` medoids; zero rows take part at distance 1."""
    if t_keep <= 0:
        raise ValueError("at least one row has to be kept")
    points = spread(prepared_points(df, id_col, numeric_cols, pca_k=pca_k, on_null=on_null,
                                    cast=cast_features_to_double)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        medoids = clara(points, t_keep, sample_size, restarts, seed, unique_ids)
    finally:
        points.unpersist()
    return kept_ids(df, id_col, medoids)
