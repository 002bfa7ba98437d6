"""k centers in rounds: farthest points per shard, then among the picks.

Each shard picks ``k`` of its rows, farthest first. The number of shards grows
with the table so that none holds more than about ``rows_per_shard`` rows. While
the picks are more than that, they are dealt to fewer shards and picked from
again: a tree of merges. The exact selection follows on what is left. With one
shard this is plain farthest-point selection. A caller may ask for a sample of
each shard; if that has too few ids the rest is taken from the whole table.

In chord lengths, ``sqrt(2 * dissimilarity)``, a round moves a row by at most
twice the best possible radius, so with ``r`` rounds, the exact one among them,
every row lies within ``2 * r`` times that radius of a pick.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.functions.hashing import hash_key, uniform, uniform_index
from keepset.functions.vectors import steps
from keepset.operators.clara import add_farthest
from keepset.operators.medoids import Medoids, farthest_point, kept_ids, nearest
from keepset.operators.points import dims_of, prepared_points, spread

ROWS_PER_SHARD = 100_000


def shard_centers(points: DataFrame, k: int, shards: int, fraction: float, seed: int = 42) -> DataFrame:
    """(id, v0 ..): up to ``k`` far apart rows of each shard's sample.

    Equal rows are kept once, then drawn by a hash where a sample is asked
    for, and dealt to shards by a hash of id and vector, so neither a frequent id nor a
    frequent row can fill a shard.
    """
    dims = dims_of(points)
    rows = points.select("id", *dims).distinct()
    row = [F.col("id"), *[steps(F.col(v)) for v in dims]]
    drawn = rows if fraction >= 1 else rows.where(uniform(seed, "sample", *row) < fraction)
    dealt = (drawn
             .withColumn("shard", uniform_index(shards, seed, "shard", *row))
             .withColumn("draw", hash_key(seed, F.col("id"))))
    schema = f"id {dict(points.dtypes)['id']}, " + ", ".join(f"{v} double" for v in dims)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", *dims], ignore_index=True)
        picked = add_farthest(rows[dims].to_numpy(), rows["id"].to_numpy(), [int(rows["draw"].argmin())], k)
        return rows.loc[picked, ["id", *dims]]

    return dealt.groupBy("shard").applyInPandas(pick, schema)


def kcenter(points: DataFrame, k: int, shards: int = 100, per_shard_sample: int | None = None,
            seed: int = 42, rows_per_shard: int = ROWS_PER_SHARD) -> Medoids:
    n = points.count()
    if n and k > n:
        raise ValueError(f"{k} rows are to be kept, but there are only {n}")
    shards = max(shards, -(-n // rows_per_shard)) if per_shard_sample is None else shards
    fraction = 1.0 if per_shard_sample is None else min(1.0, max(shards * per_shard_sample, 2 * k) / max(n, 1))
    centers = shard_centers(points, k, shards, fraction, seed).persist(StorageLevel.MEMORY_AND_DISK)
    held = [centers]
    try:
        picks = centers.count()
        while picks > rows_per_shard:
            merged = shard_centers(centers, k, -(-picks // rows_per_shard), 1.0, seed).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(merged)
            if (left := merged.count()) >= picks:
                break  # shards of k rows or less
            centers, picks = merged, left
        ids = centers.select(F.count_distinct("id")).first()[0]
        chosen = farthest_point(centers, min(k, ids), seed) if ids else farthest_point(points, k, seed)
        return chosen if len(chosen) == k else farthest_point(points, k, seed, start=chosen)
    finally:
        for one in held:
            one.unpersist()


def covering_radius(points: DataFrame, chosen: Medoids) -> float | None:
    """The largest dissimilarity of a point to its nearest chosen row, None without points. One pass."""
    return nearest(points, chosen.vectors).agg(F.lit(1.0) - F.min("sim")).first()[0]


def kcenter_medoids(df: DataFrame, id_col: str, numeric_cols: list[str], t_keep: int, *,
                    shards: int = 100, per_shard_sample: int | None = None, seed: int = 42,
                    on_null: str = "error", rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(cid, id) of ``t_keep`` rows chosen to be far apart."""
    if t_keep <= 0:
        raise ValueError("at least one row has to be kept")
    points = spread(prepared_points(df, id_col, numeric_cols, on_null=on_null)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chosen = kcenter(points, t_keep, shards, per_shard_sample, seed, rows_per_shard)
    finally:
        points.unpersist()
    return kept_ids(df, id_col, chosen)
