"""k medoids under cosine distance, on the whole table.

A medoid set is ``k`` rows, small enough to travel with each task; the points
never move. Assigning is a map step, the sums of a round are partial sums per
partition, and what leaves the executors is ``k`` rows per round.

Similarities are compared in steps of 1e-9 and equal ones go to the smallest
id, so the outcome does not depend on the order in which sums were added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepset.functions.hashing import hash_key
from keepset.functions.vectors import STEPS, steps
from keepset.operators.points import dims_of, prepared_points, spread

# Rows per matrix product.
BLOCK = 4096
# Candidates fetched per seeding pass: so many, or so many for each seed wanted up to a
# bound; and seeds after which the running best similarity is kept, so that a pass
# compares with the seeds since then only.
CANDIDATES = 1024
CANDIDATES_PER_SEED = 16
MAX_CANDIDATES = 16_384
SEEDS_PER_WRITE = 64
# Where points are kept between passes. Passes read them in order, and in memory a large table would leave an executor
# no room beside its Python workers.
HELD = StorageLevel.DISK_ONLY


@dataclass(frozen=True)
class Medoids:
    """``k`` chosen rows: their ids and their unit vectors."""
    ids: list
    vectors: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def rows(self) -> list[tuple]:
        return [(cid, i) for cid, i in enumerate(self.ids)]


def medoid_set(rows: list, dims: list[str]) -> Medoids:
    """Collected rows (id, v0 ..) as a medoid set."""
    return Medoids([r["id"] for r in rows],
                   np.array([[r[v] for v in dims] for r in rows], dtype=float).reshape(len(rows), len(dims)))


# -- assignment and cost ---------------------------------------------------

def packed(points: DataFrame) -> DataFrame:
    """The points as (ids, x), a row for each Arrow batch of them: ``x`` holds its vectors as bytes. Passes over
    them hand bytes to Python; handing over points one by one takes most of a pass."""
    dims = dims_of(points)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(v).to_numpy(zero_copy_only=False) for v in dims])
            ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), batch.column("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    return points.select("id", *dims).mapInArrow(pack, f"ids array<{dict(points.dtypes)['id']}>, x binary")


def _matrices(batches: Iterable[pa.RecordBatch], n_dims: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Each row of a packed table: its batch, its place there and its vectors."""
    for batch in batches:
        for i, x in enumerate(batch.column("x")):
            yield batch, i, np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, n_dims)


def _nearest_place(sims: np.ndarray) -> np.ndarray:
    """The place of the greatest similarity in each row, in steps; the lowest on ties."""
    return np.floor(sims * STEPS + 0.5).argmax(axis=1)


def nearest(points: DataFrame, vectors: np.ndarray) -> DataFrame:
    """The points with ``cid``, the place of the most similar vector (the
    lowest on ties), and ``sim``, that similarity.

    One matrix product per block of an Arrow batch. As an expression the
    ``k`` similarities would be interpreted one multiplication at a time, or
    compiled into a plan that grows with ``k``.
    """
    table = np.ascontiguousarray(vectors.T)

    @F.pandas_udf("cid int, sim double")
    def assign(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack(cols)
        cid, sim = np.empty(len(x), dtype=np.int32), np.empty(len(x))
        for at in range(0, len(x), BLOCK):
            s = x[at:at + BLOCK] @ table
            sim[at:at + BLOCK] = s.max(axis=1)
            cid[at:at + BLOCK] = _nearest_place(s)
        return pd.DataFrame({"cid": cid, "sim": sim})

    found = points.withColumn("_near", assign(*[F.col(v) for v in dims_of(points)]))
    return found.select(*points.columns, "_near.cid", "_near.sim")


def clustering_cost(points: DataFrame, medoid_sets: list[np.ndarray]) -> DataFrame:
    """(restart, cost): per medoid set, the sum over all points of the
    distance to the nearest medoid. All sets are evaluated in one pass."""
    n, names = len(medoid_sets), [f"sim{r}" for r in range(len(medoid_sets))]
    tables = [np.ascontiguousarray(m.T) for m in medoid_sets]

    @F.pandas_udf(", ".join(f"{name} double" for name in names))
    def best_of_each(*cols: pd.Series) -> pd.DataFrame:
        x = np.column_stack(cols)
        out = np.empty((len(x), n))
        for at in range(0, len(x), BLOCK):
            for r, table in enumerate(tables):
                out[at:at + BLOCK, r] = (x[at:at + BLOCK] @ table).max(axis=1)
        return pd.DataFrame(out, columns=names)

    sims = points.select(best_of_each(*[F.col(v) for v in dims_of(points)]).alias("s")).select("s.*")
    costs = sims.agg(*[F.sum(F.lit(1.0) - F.col(name)).alias(name) for name in names])
    lines = [F.struct(F.lit(r).alias("restart"), F.col(name).alias("cost")) for r, name in enumerate(names)]
    return costs.select(F.inline(F.array(*lines)))


# -- seeding ---------------------------------------------------------------

def first_point(points: DataFrame, seed: int) -> Medoids:
    """A repeatable random point: the smallest hash of its id and the seed."""
    dims = dims_of(points)
    order = [hash_key(seed, F.col("id")), F.col("id"), *[F.col(v) for v in dims]]
    return medoid_set(points.orderBy(*order).limit(1).collect(), dims)


def farthest_point(points: DataFrame, k: int, seed: int = 42, start: Medoids | None = None,
                   candidates: int | None = None) -> Medoids:
    """``k`` seeds: each next one is the point least similar to those chosen,
    ties to the smallest id; no id is chosen twice.

    A pass over the table brings back its least similar points, and several
    seeds are often taken from them: a similarity only grows when seeds are
    added, so as long as the best of the fetched points is still below the
    last one fetched, no point left behind can beat it. The seeds are exactly
    those of one pass per seed. More candidates are fetched for more seeds, so the passes stay few.
    """
    dims = dims_of(points)
    if candidates is None:
        candidates = min(max(CANDIDATES, CANDIDATES_PER_SEED * k), MAX_CANDIDATES)
    id_type = points.schema["id"].dataType
    chosen = first_point(points, seed) if start is None else start
    if len(chosen) == 0:
        return chosen
    ids, vectors = list(chosen.ids), [np.array(v) for v in chosen.vectors]
    work, written, held = points.withColumn("_best", F.lit(-2.0)), 0, []
    try:
        while len(ids) < k:
            fresh = nearest(work, np.array(vectors[written:]))
            running = fresh.withColumn("_best", F.greatest("_best", "sim")).drop("cid", "sim")
            if len(ids) - written >= SEEDS_PER_WRITE:
                work, written = running.persist(HELD), len(ids)
                held.append(work)
            taken = points.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("id", id_type)]))  # fewer than k rows
            least = (running.join(F.broadcast(taken), "id", "left_anti").withColumn("_step", steps(F.col("_best")))
                     .orderBy("_step", "id", *dims).limit(candidates).collect())
            if len(held) > 1:
                held.pop(0).unpersist()  # its successor is filled by now
            if not least:
                raise ValueError(f"{k} rows are to be kept, but there are only {len(ids)} ids to choose from")
            for i in _greedy(least, dims, k - len(ids), complete=len(least) < candidates):
                ids.append(least[i]["id"])
                vectors.append(np.array([least[i][v] for v in dims]))
    finally:
        for one in held:
            one.unpersist()
    return Medoids(ids, np.array(vectors))


def _greedy(rows: list, dims: list[str], wanted: int, complete: bool) -> list[int]:
    """Places of the seeds that can be taken from the fetched rows."""
    x = np.array([[r[v] for v in dims] for r in rows])
    best = np.array([r["_best"] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["id"], tuple(x[i])))
    rank = np.empty(len(rows), dtype=np.int64)
    rank[order] = np.arange(len(rows))
    numbers: dict = {}
    same_id = np.array([numbers.setdefault(r["id"], len(numbers)) for r in rows])
    limit, taken = (rows[-1]["_step"], rank[-1]), []
    is_open = np.ones(len(rows), dtype=bool)
    while len(taken) < wanted and is_open.any():
        step = np.where(is_open, np.floor(best * STEPS + 0.5), np.inf)
        ties = np.flatnonzero(step == step.min())
        at = int(ties[rank[ties].argmin()])
        if not complete and (step[at], rank[at]) > limit:
            break
        taken.append(at)
        is_open &= same_id != same_id[at]
        best = np.maximum(best, x @ x[at])
    return taken


# -- one round -------------------------------------------------------------

def cluster_sums(assigned: DataFrame) -> DataFrame:
    """(cid, n, s0 ..): number of members and sum of their vectors. Summed on
    each partition first; one row per cluster and partition is shuffled."""
    dims = dims_of(assigned)
    return assigned.groupBy("cid").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(dims)])


def assigned_sums(blocks: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``cluster_sums`` of packed points with their nearest vectors, summed where they are assigned: no point goes
    back from Python, a task passes on one row per cluster."""
    n_dims, table = vectors.shape[1], np.ascontiguousarray(vectors.T)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(vectors), dtype=np.int64), np.zeros(vectors.shape)
        for _, _, x in _matrices(batches, n_dims):
            for at in range(0, len(x), BLOCK):
                part = x[at:at + BLOCK]
                near = _nearest_place(part @ table)
                count += np.bincount(near, minlength=len(vectors))
                for i in range(n_dims):
                    total[:, i] += np.bincount(near, weights=part[:, i], minlength=len(vectors))
        cid = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(cid.astype(np.int32)), pa.array(count[cid]), *[
            pa.array(total[cid, i]) for i in range(n_dims)]], ["cid", "n", *[f"s{i}" for i in range(n_dims)]])

    schema = "cid int, n long, " + ", ".join(f"s{i} double" for i in range(n_dims))
    return blocks.select("x").mapInArrow(summed, schema).groupBy("cid").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(n_dims)])


def medoid_update(points: DataFrame, medoids: Medoids, blocks: DataFrame | None = None) -> dict[int, Row]:
    """cid -> (score, id, v0 ..): in each cluster the member with the smallest
    total distance to the others, the smallest (id, vector) on ties.

    The total similarity of a member is its dot product with the cluster's
    sum, so no two members are compared: one pass for the sums, one for the
    scores. In the second each task passes on its best row per cluster only.

    Different clusters get different ids. Where the best rows of two share
    one, the cluster with the better score has it and the other looks again
    among the ids not taken; one that finds none is left out. ``blocks``: the
    points packed, if that was done before.
    """
    dims, blocks = dims_of(points), packed(points) if blocks is None else blocks
    means = np.zeros_like(medoids.vectors)
    for r in assigned_sums(blocks, medoids.vectors).collect():
        means[r["cid"]] = np.array([r[f"s{i}"] for i in range(len(dims))]) / r["n"]

    found = _best_rows(blocks, medoids.vectors, means, list(range(len(medoids))), [])
    while True:
        holder: dict = {}
        for c, r in sorted(found.items(), key=lambda item: (-item[1]["score"], item[0])):
            holder.setdefault(r["id"], c)
        losers = [c for c, r in found.items() if holder[r["id"]] != c]
        if not losers:
            return found
        for c in losers:
            del found[c]
        found.update(_best_rows(blocks, medoids.vectors, means, losers, list(holder)))


def _best_rows(blocks: DataFrame, vectors: np.ndarray, means: np.ndarray, clusters: list[int],
               taken: list) -> dict[int, Row]:
    """cid -> (score, id, v0 ..) of the best member whose id is not taken."""
    dims, table = [f"v{i}" for i in range(vectors.shape[1])], np.ascontiguousarray(vectors.T)
    order = [("cid", "ascending"), ("score", "descending"), ("id", "ascending"), *[(v, "ascending") for v in dims]]
    wanted = np.isin(np.arange(len(vectors)), clusters)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, top = None, np.full(len(vectors), np.iinfo(np.int64).min)  # the best row and score so far of each cluster
        for batch, i, x in _matrices(batches, len(dims)):
            cid, mean_sim = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for at in range(0, len(x), BLOCK):
                part = x[at:at + BLOCK]
                near = _nearest_place(part @ table)
                cid[at:at + BLOCK] = near
                mean_sim[at:at + BLOCK] = np.einsum("ij,ij->i", part, means[near])
            score = np.floor(mean_sim * STEPS + 0.5).astype(np.int64)
            able = wanted[cid]
            ids = batch.column("ids")[i].values
            if taken:
                able &= ~np.asarray(pc.is_in(ids, value_set=pa.array(taken, ids.type)))
            np.maximum.at(top, cid[able], score[able])
            rows = np.flatnonzero(able & (score == top[cid]))
            if len(rows):
                found = pa.table([pa.array(cid[rows]), pa.array(score[rows]), ids.take(pa.array(rows)), *x[rows].T],
                                 ["cid", "score", "id", *dims])
                held = found if held is None else pa.concat_tables([held, found])
                held = held.sort_by(order)
                first = held.column("cid").to_numpy()
                held = held.take(pa.array(np.flatnonzero(np.append(True, first[1:] != first[:-1]))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"cid int, score long, id {kind}, " + ", ".join(f"{v} double" for v in dims)
    each = blocks.mapInArrow(best, schema)  # k rows a task at most
    least = each.groupBy("cid").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", *dims)).alias("w"))
    return {r["cid"]: r for r in least.select("cid", (-F.col("w.s")).alias("score"), "w.id", *[F.col(f"w.{v}") for v in dims]).collect()}


def pam_round(points: DataFrame, medoids: Medoids, blocks: DataFrame | None = None) -> Medoids:
    """Assign every point, then move each medoid to its cluster's best member.

    A cluster that lost all its members to an equal medoid, or all its ids to
    other clusters, restarts from the point farthest from the others.
    """
    dims = dims_of(points)
    found = medoid_update(points, medoids, blocks)
    moved = medoid_set([found[c] for c in sorted(found)], dims)
    if len(found) == len(medoids):
        return moved
    grown = farthest_point(points, len(medoids), start=moved)
    spare = iter(range(len(moved), len(medoids)))
    place = dict(zip(sorted(found), range(len(moved))))
    order = [place[c] if c in place else next(spare) for c in range(len(medoids))]
    return Medoids([grown.ids[i] for i in order], grown.vectors[order])


def pam(points: DataFrame, k: int, seed: int = 42, max_iter: int = 20,
        start: Medoids | None = None) -> Medoids:
    """Alternate assignment and medoid update until the medoids stay the same."""
    if k <= 0:
        raise ValueError("the number of rows to keep must be positive")
    medoids = farthest_point(points, k, seed, start)
    blocks = packed(points).persist(HELD)
    try:
        for _ in range(max_iter if len(medoids) else 0):
            moved = pam_round(points, medoids, blocks)
            if moved.ids == medoids.ids and np.array_equal(moved.vectors, medoids.vectors):
                break
            medoids = moved
    finally:
        blocks.unpersist()
    return medoids


def pam_medoids(df: DataFrame, id_col: str, numeric_cols: list[str], t_keep: int, *, pca_k: int = 0,
                seed: int = 42, max_iter: int = 20, on_null: str = "error",
                cast_features_to_double: bool = True) -> DataFrame:
    """(cid, id) of the ``t_keep`` medoids of the whole table; rows whose
    features are all zero take no part. Empty for an empty table, and an error
    if there are fewer ids than rows to keep."""
    if t_keep <= 0:
        raise ValueError("at least one row has to be kept")
    points = spread(prepared_points(df, id_col, numeric_cols, pca_k=pca_k, drop_zero=True, on_null=on_null,
                                    cast=cast_features_to_double)).persist(HELD)
    try:
        medoids = pam(points, t_keep, seed, max_iter)
    finally:
        points.unpersist()
    return kept_ids(df, id_col, medoids)


def kept_ids(df: DataFrame, id_col: str, medoids: Medoids) -> DataFrame:
    """(cid, id) of a medoid set, as a table that joins by broadcast: Spark does not know how few rows the driver gave it,
    and would shuffle a base table to join them."""
    kind = df.schema[id_col].dataType.simpleString()
    return F.broadcast(df.sparkSession.createDataFrame(medoids.rows(), f"cid int, id {kind}"))


