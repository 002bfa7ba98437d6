import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keepset.operators import clara as C
from keepset.operators import kcenter as K
from keepset.operators import medoids as M
from keepset.operators.points import dims_of, pca_points, feature_points, prepared_points
from keepset.operators.reduced import reduced_set

SIX = [(1, 1., 0.), (2, 10., 1.), (3, 5., 1.), (4, 0., 1.), (5, 1., 10.), (6, 1., 4.)]
SEVEN = [*SIX, (7, 0., 0.)]
XY = ["x", "y"]


@pytest.fixture(scope="module")
def seven(spark):
    return spark.createDataFrame(SEVEN, "id long, x double, y double").repartition(3).cache()


@pytest.fixture(scope="module")
def cloud(spark):
    """300 rows, ids that repeat, one row with a third of all copies."""
    rng = random.Random(3)
    rows = [(rng.randrange(150), *[rng.gauss(c, 1) for c in rng.choice([(5, 0, 1), (0, 5, 2), (-4, 1, 5)])])
            for _ in range(200)] + [(999, 1., 1., 9.)] * 100
    return spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(4).cache()


def start(points):
    return M.first_point(points.where("id = 1"), 0)


def cost(points, medoids):
    return M.clustering_cost(points, [medoids.vectors]).first()["cost"]


def as_numpy(points):
    rows = points.orderBy("id", *dims_of(points)).collect()
    return [r["id"] for r in rows], np.array([[r[v] for v in dims_of(points)] for r in rows])


def brute_farthest(ids, x, first, k):
    chosen = [first]
    while len(chosen) < k:
        open_rows = [i for i in range(len(ids)) if ids[i] not in {ids[c] for c in chosen}]
        best = {i: math.floor(max(float(x[i] @ x[c]) for c in chosen) * 1e9 + 0.5) for i in open_rows}
        chosen.append(min(open_rows, key=lambda i: (best[i], ids[i])))
    return [ids[c] for c in chosen]


@pytest.mark.parametrize("drop_zero, base", [(True, 0.0), (False, 1.0)])
def test_golden_rounds(seven, drop_zero, base):
    points = prepared_points(seven, "id", XY, drop_zero=drop_zero)
    seeds = M.farthest_point(points, 2, start=start(points))
    assert seeds.ids == [1, 4]
    assert math.isclose(cost(points, seeds), base + 0.059202444, abs_tol=1e-9)
    first = M.pam_round(points, seeds)
    assert first.ids == [2, 5] == M.pam_round(points, first).ids
    assert math.isclose(cost(points, first), base + 0.025236030, abs_tol=1e-9)
    clusters = {}
    for r in M.nearest(points, first.vectors).collect():
        clusters.setdefault(r["cid"], set()).add(r["id"])
    assert clusters == {0: {1, 2, 3} if drop_zero else {1, 2, 3, 7}, 1: {4, 5, 6}}
    sums = {r["cid"]: (r["s0"], r["s1"]) for r in M.cluster_sums(M.nearest(points, first.vectors)).collect()}
    assert sums[0] == pytest.approx((2.975617866, 0.295619854)) and sums[1] == pytest.approx((0.342039344, 2.965179690))


@pytest.mark.parametrize("candidates", [1, 2, 50, 1000])
def test_seeds_do_not_depend_on_the_number_fetched(cloud, candidates):
    points = prepared_points(cloud, "id", ["a", "b", "c"]).cache()
    ids, x = as_numpy(points)
    first = M.first_point(points, 9)
    k = 6 if candidates == 1 else 20
    found = M.farthest_point(points, k, start=first, candidates=candidates)
    at = next(i for i in range(len(ids)) if ids[i] == first.ids[0] and np.allclose(x[i], first.vectors[0]))
    assert found.ids == brute_farthest(ids, x, at, k)
    assert len(set(found.ids)) == k


def test_seeds_survive_writing_the_running_best(cloud, monkeypatch):
    points = prepared_points(cloud, "id", ["a", "b", "c"])
    want = M.farthest_point(points, 15).ids
    monkeypatch.setattr(M, "SEEDS_PER_WRITE", 4)
    assert M.farthest_point(points, 15, candidates=3).ids == want


def test_cost_never_rises_and_update_is_the_best_member(cloud):
    points = prepared_points(cloud, "id", ["a", "b", "c"]).cache()
    medoids = M.farthest_point(points, 4)
    costs = [cost(points, medoids)]
    for _ in range(3):
        rows = M.nearest(points, medoids.vectors).collect()
        moved = M.pam_round(points, medoids)
        for c in range(4):
            own = [r for r in rows if r["cid"] == c]
            x = np.array([[r["v0"], r["v1"], r["v2"]] for r in own])
            totals = (1 - x @ x.T).sum(axis=1)
            best = min(r["id"] for r, t in zip(own, totals) if t <= totals.min() + 1e-7)
            assert moved.ids[c] == best
        medoids = moved
        costs.append(cost(points, medoids))
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))


@pytest.mark.parametrize("n_parts", [1, 32])
def test_pam_does_not_depend_on_the_layout(cloud, n_parts):
    found = M.pam_medoids(cloud.repartition(n_parts), "id", ["a", "b", "c"], 3, seed=1)
    assert [r["id"] for r in found.orderBy("cid").collect()] == [
        r["id"] for r in M.pam_medoids(cloud, "id", ["a", "b", "c"], 3, seed=1).orderBy("cid").collect()]


def test_emptied_cluster_takes_the_farthest_row(spark):
    rows = [(1, 1., 0.), (2, 2., 0.), (3, 1., .1), (4, 0., 1.), (5, -1., 0.)]
    points = prepared_points(spark.createDataFrame(rows, "id int, x double, y double"), "id", XY)
    twins = M.Medoids([1, 2], np.array([[1., 0.], [1., 0.]]))
    moved = M.pam_round(points, twins)
    assert len(set(moved.ids)) == 2 and moved.ids[1] == 5


def test_several_matrices_in_one_cost_pass(cloud):
    points = prepared_points(cloud, "id", ["a", "b", "c"])
    ids, x = as_numpy(points)
    sets = [x[:3], x[10:15]]
    found = [r["cost"] for r in M.clustering_cost(points, sets).orderBy("restart").collect()]
    assert found == pytest.approx([(1 - (x @ s.T).max(axis=1)).sum() for s in sets])


def test_argument_guards(spark, seven):
    for run in (M.pam_medoids, C.clara_medoids, K.kcenter_medoids):
        with pytest.raises(ValueError):
            run(seven, "id", XY, 0)
        with pytest.raises(ValueError):
            run(seven, "id", XY, 8)
        assert run(seven.where("id > 100"), "id", XY, 2).count() == 0
        assert run(seven, "id", ["id", *XY], 1).count() == 1
    with pytest.raises(ValueError):
        M.pam_medoids(seven, "id", XY, 7)  # the zero row takes no part
    null = spark.createDataFrame([(1, 3., None), (2, 1., 1.)], "id int, x double, y double")
    with pytest.raises(PySparkException, match="null in a feature column"):
        M.pam_medoids(null, "id", XY, 1)
    assert [r["id"] for r in M.pam_medoids(null, "id", XY, 1, on_null="drop").collect()] == [2]
    with pytest.raises(TypeError):
        M.pam_medoids(seven.selectExpr("id", "cast(x AS string) AS x"), "id", ["x"], 1, cast_features_to_double=False)


def test_clara_is_no_worse_than_its_seeds(cloud):
    points = prepared_points(cloud, "id", ["a", "b", "c"]).cache()
    chosen = C.clara(points, 4, sample_size=120, restarts=3, seed=5)
    assert len(set(chosen.ids)) == 4
    assert cost(points, chosen) <= cost(points, M.farthest_point(points, 4)) + 1e-9
    everything = C.clara(points, 4, sample_size=10**6, restarts=1, seed=5)
    assert everything.ids == M.pam(points, 4, max_iter=50, start=M.first_point(points, 5)).ids


def test_samples(cloud):
    points = prepared_points(cloud, "id", ["a", "b", "c"])
    whole = C.clara_samples(points, 1.0, 2).groupBy("restart").sum("copies").collect()
    assert [r["sum(copies)"] for r in whole] == [300, 300]
    assert C.clara_samples(points, 1.0, 1).where("id = 999").collect()[0]["copies"] == 100
    half = {r["restart"]: r["sum(copies)"] for r in C.clara_samples(points, .5, 4).groupBy("restart").sum("copies").collect()}
    assert len(half) == 4 and all(100 < n < 200 for n in half.values())
    by_id = C.clara_samples(points.dropDuplicates(["id"]), .5, 2, unique_ids=True).select("restart", "id")
    again = C.clara_samples(points.dropDuplicates(["id"]).repartition(7), .5, 2, unique_ids=True).select("restart", "id")
    assert sorted(by_id.collect()) == sorted(again.collect())


def test_short_sample_is_completed(cloud):
    points = prepared_points(cloud.dropDuplicates(["id"]), "id", ["a", "b", "c"])
    n_ids = points.count()
    chosen = C.clara(points, n_ids, sample_size=5, restarts=2)
    assert len(set(chosen.ids)) == n_ids


def test_kcenter_with_one_shard_is_farthest_point(cloud):
    points = prepared_points(cloud, "id", ["a", "b", "c"]).cache()
    assert K.kcenter(points, 8, shards=1, per_shard_sample=10**6, seed=4).ids == M.farthest_point(points, 8, 4).ids

    def radius(m):
        return 1 - min(r["sim"] for r in M.nearest(points, m.vectors).select("sim").collect())
    sharded = K.kcenter(points, 8, shards=5, per_shard_sample=10**6, seed=4)
    assert len(set(sharded.ids)) == 8 and radius(sharded) <= 4 * radius(M.farthest_point(points, 8, 4)) + 1e-9


def test_pca_keeps_cosines_when_no_dimension_is_lost(spark):
    rng = random.Random(8)
    rows = [(i, *[rng.gauss(0, s) for s in (3, 2, 1)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    before, after = (as_numpy(p)[1] for p in (feature_points(df, "id", ["a", "b", "c"]),
                                             pca_points(feature_points(df, "id", ["a", "b", "c"]), 9)))
    assert after.shape == (60, 3)
    assert np.allclose(before @ before.T, after @ after.T)
    one = as_numpy(pca_points(feature_points(df, "id", ["a", "b", "c"]), 1))[1]
    assert np.var(one) >= max(np.var(before, axis=0)) - 1e-9


def test_reduced_set_keeps_one_row_per_id(spark, toy):
    kept = spark.createDataFrame([(0, 3), (1, 100)], "cid int, id long")
    found = sorted(tuple(r) for r in reduced_set(toy.repartition(4), kept).collect())
    assert found == [(3, 4, 14, 24, 0.4), (100, 200, 1200, 22, 0.5)]


def test_medoids_have_different_ids(spark):
    """Ids on several rows: the best rows of two clusters share one."""
    rows = [(1, 1.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 0.1), (2, 0.1, 1.0), (3, 0.9, 0.2), (4, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for seed in range(4):
        kept = M.pam_medoids(df, "id", ["x", "y"], 2, seed=seed)
        assert kept.select("id").distinct().count() == 2


def test_seeds_do_not_depend_on_the_candidates(spark):
    rows = [(1, 1.0, 0.0, 0.0), (2, 0.5, 0.86, 0.1), (2, 0.0, 0.866, 0.5), (3, 0.2, 0.3, 0.9)]
    points = M_points(spark, rows)
    for k in (2, 3):
        one, many = (M.farthest_point(points, k, candidates=c) for c in (1, 1024))
        assert one.ids == many.ids and (one.vectors == many.vectors).all()


def M_points(spark, rows):
    from keepset.operators.points import prepared_points
    return prepared_points(spark.createDataFrame(rows, "id long, x double, y double, z double"), "id", ["x", "y", "z"])


def test_no_sort_over_all_points_in_an_update(spark):
    points = M_points(spark, [(i, float(i % 7), float(i % 5), 1.0) for i in range(50)])
    found = M.medoid_update(points, M.farthest_point(points, 3))
    assert len(found) == 3 and len({r["id"] for r in found.values()}) == 3


def test_nan_and_infinity_are_refused(spark):
    for bad in (float("nan"), float("inf")):
        df = spark.createDataFrame([(1, 1.0, bad), (2, 1.0, 1.0), (3, 0.5, 2.0)], "id long, x double, y double")
        with pytest.raises(Exception, match="NaN"):
            M.pam_medoids(df, "id", ["x", "y"], 1).collect()
        assert M.pam_medoids(df, "id", ["x", "y"], 2, on_null="drop").count() == 2


def test_kcenter_looks_at_every_row(spark):
    rows = [(i, float(i % 13 + 1), float(i % 11), float(i % 7)) for i in range(900)]
    points = M_points(spark, rows)
    assert len(set(K.kcenter(points, 880, shards=2).ids)) == 880
    assert len(set(K.kcenter(points, 300, shards=2, per_shard_sample=10).ids)) == 300  # the sample is topped up


def test_kcenter_tree_keeps_the_proven_radius(spark):
    rng = random.Random(9)
    rows = [(i, *[rng.gauss(0, 1) for _ in range(4)]) for i in range(3000)]
    points = prepared_points(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), "id", list("abcd"))
    chord = lambda chosen: math.sqrt(2 * K.covering_radius(points, chosen))
    best_known = chord(M.farthest_point(points, 12, 3))
    flat, tree = K.kcenter(points, 12, shards=4, seed=3), K.kcenter(points, 12, shards=4, seed=3, rows_per_shard=100)
    assert len(set(tree.ids)) == 12 and tree.ids != flat.ids
    assert chord(flat) <= 2 * 2 * best_known
    assert chord(tree) <= 2 * 4 * best_known  # 3,000 rows, 360 picks, 48 picks, 12
    want = max(1 - max(sum(x * y for x, y in zip(r, v)) for v in tree.vectors) for r in points.select(*dims_of(points)).collect())
    assert math.isclose(K.covering_radius(points, tree), want, abs_tol=1e-12)


def test_kcenter_tree_ends_where_nothing_shrinks(spark):
    points = prepared_points(spark.createDataFrame([(i, float(i % 37 + 1), float(i)) for i in range(200)], "id long, a double, b double"), "id", ["a", "b"])
    assert len(set(K.kcenter(points, 50, shards=2, rows_per_shard=10).ids)) == 50
    assert K.covering_radius(points.limit(0), K.kcenter(points, 2)) is None


def test_clara_is_the_same_on_any_layout(spark):
    rows = [(i % 150, float(i % 13 + 1), float(i % 11), float(i % 7)) for i in range(900)]
    points = M_points(spark, rows)
    sets = [C.clara(points.repartition(n), 5, sample_size=200, restarts=3, seed=1).ids for n in (1, 4, 9)]
    assert sets[0] == sets[1] == sets[2]


def test_many_seeds_take_few_passes(spark, monkeypatch):
    """400 seeds: those of one pass per seed, in far fewer passes, with no id as a literal in the plan."""
    df = spark.range(6000).select((F.col("id") % 5000).alias("id"), *[
        (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(2001)) - 1000).cast("double").alias(c) for c in "abcd"])
    points = prepared_points(df, "id", list("abcd")).persist()
    passes, near = [], M.nearest
    monkeypatch.setattr(M, "nearest", lambda work, vectors: passes.append(len(vectors)) or near(work, vectors))
    k = 400
    found = M.farthest_point(points, k)
    rows = points.collect()
    ids, x = [r["id"] for r in rows], np.array([[r[f"v{i}"] for i in range(4)] for r in rows])
    at = next(i for i, r in enumerate(rows) if r["id"] == found.ids[0] and np.allclose(x[i], found.vectors[0]))
    points.unpersist()
    ids, best, want = np.array(ids), np.full(len(ids), -2.0), []
    for _ in range(k):  # one pass per seed
        want.append(int(ids[at]))
        best = np.maximum(best, x @ x[at])
        at = min(np.flatnonzero(~np.isin(ids, want)), key=lambda i: (math.floor(best[i] * 1e9 + 0.5), ids[i]))
    assert found.ids == want and len(passes) <= k // 10


def test_rounds_read_points_packed_once(cloud, monkeypatch):
    points = prepared_points(cloud, "id", ["a", "b", "c"])
    blocks = M.packed(points.repartition(3)).cache()
    assert blocks.count() == 3  # a pass hands over a row for each batch of points, not one for each point
    seeds = M.farthest_point(points, 4)
    near = {r["cid"]: r for r in M.cluster_sums(M.nearest(points, seeds.vectors)).collect()}
    for r in M.assigned_sums(blocks, seeds.vectors).collect():
        assert r["n"] == near[r["cid"]]["n"] and tuple(r) == pytest.approx(tuple(near[r["cid"]]))
    assert M.medoid_update(points, seeds, blocks) == M.medoid_update(points, seeds)
    made, pack = [], M.packed
    monkeypatch.setattr(M, "packed", lambda df: made.append(df) or pack(df))
    want = seeds
    for _ in range(3):
        want = M.pam_round(points, want, blocks)
    assert M.pam(points, 4, start=M.first_point(points, 42), max_iter=3).ids == want.ids and len(made) == 1


def test_packed_points_keep_ids_of_any_kind(spark):
    rows = [("é", 1., 0.), ("a", 1., 0.), ("z", 0., 1.), ("z", 0., 2.), ("b", 1., 1e-3)]
    for kind in ("string", "binary"):
        df = spark.createDataFrame(rows, "id string, x double, y double").withColumn("id", F.col("id").cast(kind))
        found = sorted(bytes(r["id"]) if kind == "binary" else r["id"].encode() for r in M.pam_medoids(df, "id", XY, 2).collect())
        assert found == [b"a", b"z"]


def test_kept_ids_join_without_moving_the_base_table(spark, cloud):
    kept = M.pam_medoids(cloud, "id", ["a", "b", "c"], 3)
    small = reduced_set(cloud, kept, "id")
    plan = small._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    ids = {r.id for r in kept.collect()}
    want = {i: min(tuple(r)[1:] for r in cloud.collect() if r.id == i) for i in ids}
    assert {r.id: tuple(r)[1:] for r in small.collect()} == want and len(ids) == 3


def test_points_are_not_held_in_memory_between_passes(spark, cloud, monkeypatch):
    levels, kind = [], type(cloud)
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, level: levels.append(level) or persist(self, level))
    monkeypatch.setattr(M, "SEEDS_PER_WRITE", 2)
    assert M.pam_medoids(cloud, "id", ["a", "b", "c"], 7).count() == 7
    points = prepared_points(cloud, "id", ["a", "b", "c"])
    M.farthest_point(points, 7, candidates=2)
    assert len(levels) > 2 and not any(level.useMemory for level in levels)
