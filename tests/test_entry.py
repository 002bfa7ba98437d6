import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["features_dropna", "column_stats", "workload_dicts", "workload_sql", "pop_multi", "pop_or", "pop_nullsafe",
           "avg_dissim_repeated_ids", "importance_avg", "importance_sum", "farthest_point_repeated_ids",
           "medoids_pam", "clara_samples", "reduced_set", "scan_csv", "pca_lengths", "pop_rows", "pop_exact", "pop_exact_join",
           "pop_generated_text", "clara_samples_folded", "kcenter_sharded", "pam_reduced_set"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def as_rows(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    want = as_rows(duck.execute(entry.oracle_sql()[name]).fetchdf())
    assert as_rows(entry.queries()[name](spark, SF).toPandas()) == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    found = entry.entry(spark)
    assert found.columns == ["id", "avg_dissim", "pop", "importance"] and found.count() == 100
