import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keepset.operators import popularity as pop
from keepset.operators.workload import workload_from_dicts

TOY = [{"A": 4}, {"A": 8, "B": 18}, {"C": 25}, {"A": 200, "C": 22}, {"A": 4, "C": 25}]
ENGINES = [{}, {"max_case": 0}, {"max_case": 0, "max_broadcast": 2}, {"max_case": 0, "max_broadcast": 1}]


def as_dict(df):
    found = df.collect()
    assert len({r["id"] for r in found}) == len(found)
    return {r["id"]: r["pop"] for r in found}


def brute(rows, names, queries, connector="AND", null_safe=False, empty="none"):
    """Popularity by id, by looping over rows and queries."""
    out = {}
    for row in rows:
        record = dict(zip(names, row))
        n = 0
        for q in queries:
            held = [(record[c] is None if null_safe else False) if v is None
                    else record[c] is not None and record[c] == v for c, v in q.items()]
            n += (all(held) if connector == "AND" else any(held)) if q else empty == "all"
        out[record["id"]] = out.get(record["id"], 0) + n
    return out


@pytest.mark.parametrize("options", ENGINES)
def test_toy_goldens(spark, toy, options):
    assert as_dict(pop.popularity(toy, TOY, **options)) == {3: 5, 100: 1, 2: 1}
    either = workload_from_dicts(spark, TOY, "OR")
    assert as_dict(pop.popularity(toy, either, **options)) == {3: 9, 100: 1, 2: 2}


@pytest.mark.parametrize("options", ENGINES[:2])
def test_empty_queries(toy, options):
    queries = [*TOY, {}]
    assert as_dict(pop.popularity(toy, queries, **options)) == {3: 5, 100: 1, 2: 1}
    assert as_dict(pop.popularity(toy, queries, empty_query="all", **options)) == {3: 10, 100: 2, 2: 2}
    assert as_dict(pop.popularity(toy, [], **options)) == {3: 0, 100: 0, 2: 0}


@pytest.mark.parametrize("connector", ["AND", "OR"])
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("options", ENGINES[:2] + [{"max_case": 0, "max_broadcast": 13}])
def test_against_brute_force(spark, connector, null_safe, options):
    rng = random.Random(f"{connector}{null_safe}{sorted(options)}")
    some = [None, 0, 1, 2, 3]
    rows = [(rng.randrange(6), rng.choice(some), rng.choice(some),
             rng.choice([None, 0.0, 1.0, 1.5, 2.0, float("inf"), float("nan"), -1e300]),
             rng.choice([None, 1, 2**62])) for _ in range(200)]
    # an id with a third of all rows
    rows += [(99, rng.choice(some), 1, 2.0, 2) for _ in range(100)]
    names = ["id", "a", "b", "x", "big"]
    df = spark.createDataFrame(rows, "id int, a int, b long, x double, big long").repartition(5)
    queries = []
    for _ in range(15):
        picked = rng.sample(["a", "b", "x"], rng.randint(1, 3))
        queries.append({c: rng.choice([None, 0, 1, 2, 3]) for c in picked})
    queries += [dict(queries[0]), {}]
    workload = workload_from_dicts(spark, queries, connector)
    want = brute(rows, names, queries, connector, null_safe)
    assert as_dict(pop.popularity(df, workload, "id", null_safe=null_safe, **options)) == want


@pytest.mark.parametrize("null_safe", [False, True])
def test_constants_too_large_to_pack(spark, null_safe):
    big = 2**62
    rows = [(1, big, 1), (1, big + 1, 1), (2, None, 1), (3, -2**63, 2), (3, big, None), (4, 2**63 - 1, 1)]
    df = spark.createDataFrame(rows, "id int, a long, b long")
    queries = [{"a": big}, {"a": big + 1, "b": 1}, {"a": None}, {"a": -2**63}, {"a": big, "b": None}, {"b": 1}]
    want = brute(rows, ["id", "a", "b"], queries, null_safe=null_safe)
    assert as_dict(pop.popularity(df, queries, "id", null_safe=null_safe, max_case=0)) == want
    # packed keys, with base values out of their range
    small = [{"b": 1}, {"a": 5}, {"a": None, "b": 1}, {"b": None}]
    want = brute(rows, ["id", "a", "b"], small, null_safe=null_safe)
    assert as_dict(pop.popularity(df, small, "id", null_safe=null_safe, max_case=0)) == want


def test_repeated_columns_in_a_query(spark, toy):
    schema = "query_id long, connector string, cond_no int, col string, val long, n_conds int"
    twice = [(0, "AND", 0, "A", 4, 2), (0, "AND", 1, "A", 5, 2), (1, "OR", 0, "A", 4, 3), (1, "OR", 1, "A", 4, 3),
             (1, "OR", 2, "A", 5, 3), (2, "AND", 0, "A", 8, 2), (2, "AND", 1, "A", 8, 2)]
    w = spark.createDataFrame(twice, schema)
    for options in ENGINES[:2]:
        assert as_dict(pop.popularity(toy, w, **options)) == {3: 5, 2: 1, 100: 0}


@pytest.mark.parametrize("options", ENGINES[:2])
def test_rows_keep_their_number(toy, options):
    found = sorted((r["id"], r["pop"]) for r in pop.row_popularity(toy, TOY, **options).collect())
    assert found == [(2, 1), (3, 1), (3, 1), (3, 1), (3, 1), (3, 1), (100, 1)]


def test_merging_and_ranking(toy):
    parts = [pop.popularity(toy, TOY[:2]), pop.popularity(toy, TOY[2:])]
    whole = {3: 5, 100: 1, 2: 1}
    assert as_dict(pop.merge_by_join(parts)) == as_dict(pop.merge_by_union(parts)) == whole
    ranked = pop.popularity_in_batches(toy, [TOY[:2], TOY[2:]]).collect()
    assert [r["id"] for r in ranked] == [3, 2, 100]


def test_layout_independence(toy):
    for n in (1, 16):
        assert as_dict(pop.popularity(toy.repartition(n), TOY, max_case=0)) == {3: 5, 100: 1, 2: 1}


def test_bad_input(spark, toy):
    with pytest.raises(ValueError):
        pop.popularity(toy, TOY, empty_query="some")
    with pytest.raises(TypeError):
        pop.popularity(spark.sql("SELECT 1 AS id, 'x' AS t"), [{"t": 1}], "id")
    with pytest.raises(PySparkException, match="null in column"):
        pop.popularity(spark.sql("SELECT cast(null AS int) AS id, 1 AS a"), [{"a": 1}], "id").collect()


def test_base_is_not_shuffled_before_the_sums(toy):
    plan = pop.popularity(toy, TOY, max_case=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert "partial_sum" in plan and "SortMergeJoin" not in plan


def test_one_answer_whatever_the_size_of_the_workload(spark):
    """Doubles, floats and decimals about 2^53, as CASE terms and as a join, at 64 and at 65 conditions."""
    big = 2**53
    rows = [(1, float(big), 0.5, Decimal("9007199254740993.50")), (2, float(big), 3.0, Decimal("9007199254740993.00")),
            (3, 7.0, float("nan"), Decimal("7.00")), (4, float("inf"), None, None), (5, -0.0, 16777216.0, Decimal("-3.25"))]
    df = spark.createDataFrame(rows, "Unique_ID long, d double, f float, m decimal(20,2)")
    queries = [{"d": big + 1}, {"d": big}, {"m": big + 1}, {"m": 7, "d": 7}, {"f": 3}, {"f": 16777217}, {"d": 0}, {"m": -3}]
    fill = [{"d": 10**6 + i} for i in range(80)]
    found = []
    for n, options in ((64, {}), (65, {}), (64, {"max_case": 0}), (64, {"max_case": 0, "null_safe": True})):
        work = (queries + fill)[:n - 1]  # one query has two conditions
        assert sum(map(len, work)) == n
        found.append({r["id"]: r["pop"] for r in pop.popularity(df, work, **options).collect()})
    assert found[0] == {1: 2, 2: 4, 3: 1, 4: 0, 5: 1} and all(f == found[0] for f in found)


def test_rows_are_not_shuffled_for_a_small_workload(spark, toy):
    found = pop.row_popularity(toy, TOY)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted(found.collect())
    for options in ENGINES:
        assert sorted(pop.row_popularity(toy, TOY, **options).collect()) == want


def test_a_long_query_does_not_widen_the_short_ones(spark):
    names = [f"c{i}" for i in range(20)]
    rows = [tuple((i * (j + 3)) % 4 for j in range(20)) for i in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "Unique_ID long, " + ", ".join(f"{c} int" for c in names))
    queries = [{names[q % 20]: q % 4} for q in range(90)] + [{names[q % 20]: 1, names[(q + 5) % 20]: 2} for q in range(30)]
    queries += [dict(zip(names, rows[7]))]
    layout = pop._Layout(names, [False] * 20, [True] * 20, False, False)
    workload, shape = workload_from_dicts(spark, queries), pop._Shape(longest=20, has_and=True, has_null=False)
    lookup = pop._lookup(workload, layout, df, shape, pop._heat(df, layout))
    assert lookup.columns == ["key", "times", "want", "rest"]
    assert sorted({len(r["rest"]) for r in lookup.collect()}) == [0, 1, 19] and sum(r["times"] for r in lookup.collect()) == len(queries)
    assert as_dict(pop.popularity(df, queries, max_broadcast=150)) == {i: sum(all(r[names.index(c)] == v for c, v in q.items()) for q in queries) for i, r in enumerate(rows)}


def test_a_hot_constant_is_split(spark):
    """A third of the rows hold one constant and one id; no part of a key has much more than 1/1000 of the cells."""
    df = spark.range(0, 60_000, 1, 40).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("Unique_ID"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50_000).alias("a"), (F.col("id") % 5).alias("b"))
    layout = pop._Layout(["a", "b"], [False] * 2, [True] * 2, False, False)
    split = pop._split(pop._heat(df, layout))
    cells = df.select("Unique_ID", F.explode(F.slice(layout.cells(df), 1, 2)).alias("_key"))
    sizes = [r["count"] for r in pop._dealt_cells(cells, split, ["Unique_ID"]).groupBy("_key", "_part").count().collect()]
    assert split.count() < pop.PARTS and sum(sizes) == 120_000 and max(sizes) <= 20 * 120
    many = [{"a": i} for i in range(30_000)] + [{"a": 7, "b": 1}, {"a": 7, "b": 2}]
    found = pop.popularity(df, many, max_broadcast=1000)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i in range(60_000):
        hot = i % 3 == 0
        key, a = (-1, 7) if hot else (i, i % 50_000)
        want[key] = want.get(key, 0) + (a < 30_000) + (a == 7 and i % 5 in (1, 2))
    assert as_dict(found) == want


def test_many_columns_of_single_conditions(spark):
    names = [f"c{i}" for i in range(30)]
    rows = [tuple((i * (j + 3)) % 7 if (i + j) % 11 else None for j in range(30)) for i in range(80)]
    df = spark.createDataFrame([(i % 50, *r) for i, r in enumerate(rows)], "Unique_ID long, " + ", ".join(f"{c} int" for c in names))
    queries = [{names[q % 30]: q % 8} for q in range(200)] + [{}]
    found = pop.popularity(df, queries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan
    assert as_dict(found) == as_dict(pop.popularity(df, queries, max_case=0)) == as_dict(pop.popularity(df, queries, max_case=0, max_broadcast=1))
