import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from keepset.llm import decontamination, quality
from keepset.llm.store import stored, table

from test_duplicates import brute_components
from test_search import brute

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert "op6_sharding" in entry.oracle_sql() and "pipeline" not in entry.oracle_sql()


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality"](spark, docs, SF), "t")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and kept < set(before)
    known = [d for d in labels if d in before]
    assert sum((d in kept) == labels[d] for d in known) > 0.95 * len(known)
    fresh = stored(stages["line_dedup"](spark, good, SF), "t")
    seen, text = set(), {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):  # exact repeats at least
        for line in (r.text or "").split("\n"):
            if len(line.strip()) >= 20 and line.strip() in seen:
                text.setdefault(r.doc_id, set()).add(line)
            seen.add(line.strip())
    after = {r.doc_id: r for r in fresh.collect()}
    assert fresh.columns == columns and text
    for d, gone in text.items():
        assert d not in after or not gone & set(after[d].text.split("\n")) or any(after[d].text.count(g) == 1 for g in gone)
    single = stored(stages["near_dedup"](spark, fresh, SF), "t")
    component, _ = brute_components([(r.doc_id, r.text) for r in fresh.collect()], 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, c in component.items() if d == c)
    clean = stored(stages["decontamination"](spark, single, SF), "t")
    want = brute([(r.doc_id, r.text) for r in single.collect()], [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in want if not r[-1])
    packed = stages["packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()))
    assert tokens(corpus_pipeline.run(spark, SF)) == tokens(packed)


def test_oracle_of_shards(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op6_sharding"]).fetchdf()
    got = entry.queries()["op6_sharding"](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(got.columns)].values.tolist()))
