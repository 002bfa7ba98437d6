import pytest

from keepset.session import clear_scratch, materialize, scratch_path, shared_dir
from keepset.sources import runlog, tables


def test_csv_with_and_without_a_schema(spark, toy):
    path = scratch_path(spark, "toy")
    toy.write.csv(path, header=True)
    given = tables.read_csv(spark, path, toy.schema)
    assert given.schema == toy.schema and sorted(given.collect()) == sorted(toy.collect())
    inferred = tables.read_csv(spark, path)
    assert dict(inferred.dtypes)["A"] == "int" and dict(inferred.dtypes)["popularity"] == "double"


def test_views_and_local_tables(spark, toy):
    tables.register({"kept_toy": toy})
    assert spark.sql("SELECT count(*) AS n FROM kept_toy WHERE A = 4").first()["n"] == 4
    assert tables.local_table(spark, [], "a int").count() == 0


def test_runlog_append_and_curves(spark):
    path = scratch_path(spark, "runs")
    for n in (1000, 50000):
        runlog.append_runs(runlog.run_record(spark, n, 3, 100, 1, n / 1000), path)
    runs = runlog.read_runs(spark, path)
    assert runs.count() == 2
    curve = runlog.runtime_curves(runs, size_col="n_rows").collect()
    assert [(r["series"], r["size"], r["seconds"]) for r in curve] == [(100.0, 1000.0, 1.0), (100.0, 50000.0, 50.0)]


def test_headerless_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("2031-02-03 04:05:06,7000.0,30.0,2.0,8.25\n2031-02-03 04:00:00,600.0,30.0,2.0,0.75\n")
    curve = runlog.runtime_curves(runlog.read_runs_csv(spark, str(tmp_path / "log.csv"))).collect()
    assert [(r["size"], r["seconds"]) for r in curve] == [(600.0, 0.75), (7000.0, 8.25)]


def test_materialized_table_has_no_lineage(spark, toy):
    assert shared_dir(spark)
    done = materialize(toy.groupBy("A").count())
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString() and done.count() == 4


def test_scratch_is_cleared(spark, toy):
    path = scratch_path(spark, "gone")
    toy.write.parquet(path)
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
