import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keepset.functions import vectors as V
from keepset.operators import importance as imp

from test_popularity import TOY

ABC = ["A", "B", "C"]


def dissim(a, b):
    na, nb = math.hypot(*a), math.hypot(*b)
    return 1 - (sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0)


def brute_average(rows):
    out = {}
    for i in {r[0] for r in rows}:
        d = [dissim(a[1:], b[1:]) for a in rows for b in rows if a[0] == i and b[0] != i]
        if d:
            out[i] = sum(d) / len(d)
    return out


@pytest.mark.parametrize("options", [{}, {"max_case": 0}])
def test_toy_goldens(toy, options):
    found = imp.importance(toy, TOY, ABC, **options).collect()
    assert [r["id"] for r in found] == [3, 100, 2]
    want = {3: (0.230965590, 5, 1.154827951), 100: (0.460350403, 1, 0.460350403), 2: (0.076866788, 1, 0.076866788)}
    for r in found:
        avg, pop, total = want[r["id"]]
        assert r["pop"] == pop
        assert math.isclose(r["avg_dissim"], avg, abs_tol=1e-9)
        assert math.isclose(r["importance"], total, abs_tol=1e-9)
    assert [r["id"] for r in imp.importance(toy, TOY, ABC, top=2, **options).collect()] == [3, 100]


def test_toy_sums(toy):
    found = sorted((r["id"], round(r["importance"], 9)) for r in imp.summed_importance(toy).collect())
    assert found == [(2, 0.230600364)] + [(3, 0.187876559)] * 4 + [(3, 0.258534185), (100, 1.381051208)]
    assert {round(r["set_importance"], 9) for r in imp.summed_importance(toy).collect()} == {0.374527428}


@pytest.mark.parametrize("n_parts", [1, 7])
def test_average_against_all_pairs(spark, n_parts):
    rng = random.Random(5)
    rows = [(rng.randrange(40), *[rng.uniform(-3, 9) for _ in range(4)]) for _ in range(90)] + [(7, 1., 2., 3., 4.)] * 45
    rows.append((50, 0.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double").repartition(n_parts)
    found = {r["id"]: r["avg_dissim"] for r in imp.average_dissimilarity(df, ["a", "b", "c", "d"], "id").collect()}
    want = brute_average(rows)
    assert found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], abs_tol=1e-12) for i in want)


def test_sum_with_hot_and_cold_ids(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i if i % 3 else 0, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, popularity double")
    want = sorted((a[0], round(a[3] * sum(dissim(a[1:3], b[1:3]) for b in rows if b[0] != a[0]), 9)) for a in rows)
    for share in (1, 20, 1000):  # no id is hot, one is, all are
        monkeypatch.setattr(imp, "HOT_SHARE", share)
        found = imp.summed_importance(df, id_col="id").collect()
        assert sorted((r["id"], round(r["importance"], 9)) for r in found) == want
        mean = sum(w for _, w in want) / len(want)
        assert all(math.isclose(r["set_importance"], mean, abs_tol=1e-7) for r in found)


def test_ids_below_the_hot_share_are_split_by_count(spark):
    n, often, bound = 200_000, 180, 40  # the id has 0.09 % of the rows
    rows = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % (n // often) == 0, -1).otherwise(F.col("id")).alias("id"),
        F.lit(1.0).alias("v0"))  # all rows of the id are equal
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    dealt, lines = imp._dealt(rows, counts, bound)
    assert dealt.count() == n
    found = dealt.join(lines, ["id", "_part"]).groupBy("id", "_part").count().groupBy("id").agg(
        F.sum("count").alias("n"), F.max("count").alias("most"), F.count("*").alias("parts")).where("n > 1").collect()
    assert len(found) == 1 and found[0]["n"] == 181 and found[0]["parts"] == 5
    assert found[0]["most"] <= 2 * bound


def test_sum_of_split_ids(spark):
    rng = random.Random(7)
    rows = [(i % 4, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, a double, b double, popularity double")
    found = [sorted((r["id"], round(r["importance"], 9)) for r in imp.summed_importance(df, id_col="id", rows_per_task=bound).collect())
             for bound in (3, 10**6)]
    assert found[0] == found[1] and len(found[0]) == 90


def test_edge_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, "id int, x double, y double")
    found = {r["id"]: r["avg_dissim"] for r in imp.average_dissimilarity(
        table([(1, 3., 4.), (2, 0., 0.), (3, 4., 3.)]), ["x", "y"], "id").collect()}
    assert all(math.isclose(found[i], d, abs_tol=1e-12) for i, d in {1: 0.52, 2: 1.0, 3: 0.52}.items())
    assert imp.average_dissimilarity(table([(1, 3., 4.)]), ["x", "y"], "id").count() == 0
    assert imp.average_dissimilarity(table([(1, 3., 4.), (1, 4., 3.)]), ["x", "y"], "id").count() == 0
    assert imp.importance(table([]), [{"x": 1}], ["x", "y"], "id").count() == 0
    null = table([(1, 3., None), (2, 1., 1.), (3, 1., 0.)])
    with pytest.raises(PySparkException, match="null in a feature column"):
        imp.average_dissimilarity(null, ["x", "y"], "id").collect()
    kept = imp.importance(null, [{"x": 1}], ["x", "y"], "id", on_null="drop").collect()
    assert sorted((r["id"], r["pop"]) for r in kept) == [(2, 1), (3, 1)]


def test_scaling_a_row_changes_no_cosine(toy):
    scaled = toy.select("Unique_ID", *[(F.col(c) * F.col("Unique_ID")).alias(c) for c in ABC])
    a = {r["id"]: r["avg_dissim"] for r in imp.average_dissimilarity(toy, ABC).collect()}
    b = {r["id"]: r["avg_dissim"] for r in imp.average_dissimilarity(scaled, ABC).collect()}
    assert all(math.isclose(a[i], b[i], abs_tol=1e-12) for i in a)


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(
        V.dot(F.col("a"), F.col("b")).alias("dot"), V.l2_norm(F.col("a")).alias("norm"),
        V.l2_normalize(F.col("a")).alias("unit"), V.l2_normalize(F.col("z")).alias("zero"),
        V.cosine(F.col("a"), F.col("b")).alias("cos"), V.dissimilarity(F.col("a"), F.col("z")).alias("far"),
        V.add_arrays(F.col("a"), F.col("b")).alias("sum")).first()
    assert (r["dot"], r["norm"], r["zero"], r["far"], r["sum"]) == (24.0, 5.0, [0.0, 0.0], 1.0, [7.0, 7.0])
    assert r["unit"] == pytest.approx([0.6, 0.8]) and r["cos"] == pytest.approx(0.96)


def test_one_exchange_feeds_rows_and_totals(toy):
    df = imp.importance(toy, TOY, ABC, top=2)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
