import math

import pytest
from pyspark.sql import functions as F

from keepset.operators import columns, stats, workload
from keepset.operators.stats import column_stats


def rows(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=str)


def test_column_stats_of_toy_table(toy):
    found = {r["col"]: r for r in column_stats({"t": toy}).collect()}
    assert list(found) == ["Unique_ID", "A", "B", "C", "popularity"]
    assert (found["A"]["min"], found["A"]["max"]) == (4, 200)
    assert math.isclose(found["B"]["mean"], 184.142857143, rel_tol=1e-9)
    assert math.isclose(found["C"]["std"], 1.812653934, rel_tol=1e-8)
    assert math.isclose(found["popularity"]["std"], 0.078679579, rel_tol=1e-7)


def test_no_statistics_for_other_types(spark):
    df = spark.sql("SELECT 1S AS small, 2Y AS tiny, 1.5BD AS dec, 'x' AS text")
    assert column_stats({"t": df}).count() == 0


def test_numeric_columns(spark):
    df = spark.sql("SELECT 1 AS id, 1S AS s, 2L AS l, 1.0D AS d, 'x' AS t")
    assert columns.numeric_columns(df, ["id"], "integral") == ["s", "l"]
    assert columns.numeric_columns(df, ["id"], "profiled") == ["l", "d"]
    assert columns.numeric_columns(df, ["id"], "any") == ["s", "l", "d", "t"]


def test_workload_has_different_columns_and_values_in_range(toy):
    stats = column_stats({"t": toy}, exclude=["Unique_ID"])
    made = workload.generate_workload(stats, 200, 3)
    per_query = made.groupBy("query_id").agg(
        F.count("*").alias("n"), F.countDistinct("col").alias("cols"), F.max("n_conds").alias("declared"))
    assert per_query.count() == 200
    assert per_query.where("n <> cols OR n <> declared OR n > 3").count() == 0
    assert {r["n"] for r in per_query.collect()} == {1, 2, 3}
    beyond = made.join(stats, "col").where("val < bround(min) OR val > bround(max)")
    assert beyond.count() == 0


def test_workload_does_not_depend_on_the_layout(toy):
    stats = column_stats({"t": toy}, exclude=["Unique_ID"])
    a = rows(workload.generate_workload(stats, 50, 2), "query_id", "cond_no", "col", "val")
    b = rows(workload.generate_workload(stats.repartition(3), 50, 2), "query_id", "cond_no", "col", "val")
    assert a == b
    assert a != rows(workload.generate_workload(stats, 50, 2, seed=7), "query_id", "cond_no", "col", "val")


def test_one_row_table_falls_back_to_the_minimum(toy):
    stats = column_stats({"t": toy.where("Unique_ID = 100")}, exclude=["Unique_ID", "popularity"])
    made = workload.generate_workload(stats, 20, 2).collect()
    assert {(r["col"], r["val"]) for r in made} <= {("A", 200), ("B", 1200), ("C", 22)}
    assert all(r["n_conds"] == 1 for r in made)


def test_no_numeric_column_gives_empty_queries(spark):
    stats = column_stats({"t": spark.sql("SELECT 'x' AS t")})
    made = workload.generate_workload(stats, 4, 2)
    assert rows(made, "query_id", "col", "n_conds") == [(i, None, 0) for i in range(4)]
    texts = workload.generate_sql_workload(["t"], "tab", stats, 3, 2)
    assert [r["sql_text"] for r in texts.collect()] == ["SELECT t FROM tab;"] * 3


def test_sql_text_runs_and_agrees_with_its_conditions(spark, toy):
    toy.createOrReplaceTempView("toy")
    stats = column_stats({"toy": toy}, exclude=["popularity"])
    made = workload.generate_sql_workload(toy.columns, "toy", stats, 30, 3)
    conds = {}
    for r in workload.sql_conditions(made).collect():
        conds.setdefault(r["query_id"], []).append((r["col"], r["val"]))
    for r in made.limit(5).collect():
        q = workload.run_query(spark, r["sql_text"])
        assert "Unique_ID" in q.columns and 1 <= len(q.columns) <= 4
        want = f" {r['connector']} ".join(f"{c} = {v}" for c, v in conds[r["query_id"]])
        assert q.count() == toy.where(want).count()


@pytest.mark.parametrize("x, want", [(2.5, 2), (3.5, 4), (-0.5, 0)])
def test_rounding_is_half_even(spark, x, want):
    assert spark.range(1).select(F.bround(F.lit(x), 0).cast("long").alias("r")).first()["r"] == want


def test_first_rows_are_repeatable(toy):
    a = columns.first_rows(toy.repartition(5), 3, ["Unique_ID"]).collect()
    assert [r["Unique_ID"] for r in a] == [2, 3, 3] and a == columns.first_rows(toy, 3, ["Unique_ID"]).collect()


TEXTS = [
    ("SELECT a FROM t;", "AND", []),
    ("select a, `b c` from db.t where a = 4", "AND", [("a", 4)]),
    ("SELECT * FROM t WHERE a = 4 AND b = -7 AND a = +4;", "AND", [("a", 4), ("b", -7), ("a", 4)]),
    ("  SELECT x\nFROM t\nWHERE a=1 or b  =  2 OR `c d`=3 ; ", "OR", [("a", 1), ("b", 2), ("c d", 3)]),
    ("SELECT where1 FROM t WHERE sandor = 5 AND oracle = 6", "AND", [("sandor", 5), ("oracle", 6)]),
    (f"SELECT a FROM t WHERE a = {2**63 - 1} OR a = {-2**63}", "OR", [("a", 2**63 - 1), ("a", -2**63)]),
]
MALFORMED = [None, "", "DELETE FROM t", "SELECT a FROM t WHERE", "SELECT a FROM t WHERE a = 1 AND b = 2 OR c = 3", "SELECT a FROM t WHERE a > 1",
             "SELECT a FROM t WHERE a = 'x'", "SELECT a FROM t WHERE a = 1.5", f"SELECT a FROM t WHERE a = {2**63}", "SELECT a FROM t WHERE a = 1; DROP TABLE t",
             "SELECT a FROM t WHERE a = 1 AND", "SELECT a FROM t, u WHERE a = 1", "SELECT a FROM t WHERE NOT a = 1", "SELECT a FROM t WHERE (a = 1)"]


def test_statements_are_read_from_their_text(spark):
    texts = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(TEXTS)], "query_id int, sql_text string, connector string")
    found = {}
    for r in workload.parse_sql_workload(texts).orderBy("query_id", "cond_no").collect():
        found.setdefault(r["query_id"], (r["connector"], []))[1].extend([(r["col"], r["val"])] if r["col"] else [])
        assert r["n_conds"] == len(TEXTS[r["query_id"]][2])
    assert found == {i: (connector, conds) for i, (_, connector, conds) in enumerate(TEXTS)}


@pytest.mark.parametrize("text", MALFORMED)
def test_malformed_statements_fail_or_go(spark, text):
    texts = spark.createDataFrame([(7, text), (8, TEXTS[1][0])], "query_id long, sql_text string")
    assert [r["query_id"] for r in workload.parse_sql_workload(texts, on_malformed="drop").collect()] == [8]
    with pytest.raises(Exception, match="query 7"):
        workload.parse_sql_workload(texts).collect()


def test_generated_text_says_what_its_conditions_say(toy):
    stats = column_stats({"t": toy}, exclude=["Unique_ID", "popularity"])
    made = workload.generate_sql_workload(toy.columns, "toy", stats, 200, 3)
    keys = ("query_id", "cond_no", "col", "val", "n_conds")
    assert rows(workload.parse_sql_workload(made), *keys) == rows(workload.sql_conditions(made), *keys)
    several = "n_conds > 1"
    assert rows(workload.parse_sql_workload(made).where(several), "query_id", "connector") == rows(workload.sql_conditions(made).where(several), "query_id", "connector")


def test_states_of_parts_add_up(spark, toy):
    whole = {r["col"]: r for r in column_stats({"t": toy}).collect()}
    parts = [toy.where("A < 5"), toy.where("A = 5"), toy.where("A > 5"), toy.where("A > 999")]
    states = stats.column_states({"t": parts[0]})
    for part in parts[1:]:
        states = stats.merge_states(states.unionByName(stats.column_states({"t": part})))
    for r in stats.stats_of(states).collect():
        for k in ("min", "max", "mean", "std"):
            assert math.isclose(r[k], whole[r["col"]][k], rel_tol=1e-12), (r["col"], k)
    one = stats.stats_of(stats.merge_states(stats.column_states({"t": parts[1]}))).collect()
    assert all(r["std"] is None for r in one)
    none = stats.stats_of(stats.merge_states(stats.column_states({"t": parts[3]}))).collect()
    assert [(r["min"], r["mean"], r["std"], r["low"]) for r in none] == [(None,) * 4] * 5


def test_exact_statistics_of_large_longs(spark):
    low, high = 2**53 + 1, 2**53 + 3
    df = spark.createDataFrame([(low,), (high,), (high,)], "big long")
    found = stats.stats_of(stats.merge_states(stats.column_states({"t": df.limit(1)}).unionByName(stats.column_states({"t": df.where("big > 9007199254740993")})))).first()
    assert (found["low"], found["high"]) == (low, high)
    one = stats.stats_of(stats.merge_states(stats.column_states({"t": df.where(f"big = {low}")})))
    assert {r["val"] for r in workload.generate_workload(one, 5).collect()} == {low}


def test_no_tables_no_statistics(spark):
    assert column_stats({}).collect() == [] and stats.column_states({}).collect() == []
    assert column_stats({}).columns == ["table", "col", "min", "max", "mean", "std"]
