"""The manifest against a tree built by hand."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from keepset.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(levels, place, folded):
    proof = []
    for level in levels[:-1]:
        run = list(level[place - place % 2:place - place % 2 + 2])
        proof += [d for i, d in enumerate(run) if i != place % 2]
        run[place % 2] = folded
        folded, place = digest(*run), place // 2
    return folded, proof


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def by_hand(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels_of([leaf(r) for r in own[x]]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for place, r in enumerate(own[x]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = climb(trees[x], place, leaf(r, int(hit)))
            root, more = climb(top, i, folded)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], digest(*proof, *more), root, root == top[-1][0]))
    return out


def found(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("tree", F.lit("x")).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in manifest.document_manifest(spark, path).collect()]


EDGES = [(3, "a:b", "en", "s", 3), (1, "", "en", None, 0), (2, None, "en", "s", None), (None, "no id", "en", "s", 5), (9, "x" * 200_000, None, None, 7),
         (-4, "é\n", "é", "s", 2), (7, "alone", "zz", "s", 5), (8, "twice", "fr", "s", 5), (8, "twice", "fr", "s", 5), (8, "once more", "fr", "s", 9)]


@pytest.mark.parametrize("rows", [EDGES, EDGES[:1], [], [(i, f"t{i}", "en" if i % 5 else "de", "s", i) for i in range(331)],
                                  [(i, "t", f"l{i % 90}", "s", i) for i in range(200)], [(i, "t", "en", "s", None if i % 2 else 4) for i in range(129)]])
def test_equals_the_tree_by_hand(spark, tmp_path, rows):
    got = found(spark, rows, str(tmp_path))
    assert Counter(got) == Counter(by_hand(rows))


def test_tampering_shows(spark, tmp_path):
    got = {r[0]: r[-1] for r in found(spark, [(i, "t", "en", "s", 4) for i in range(100)], str(tmp_path))}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(100)} and not all(got.values())


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({manifest.oracle()})").fetchall()
    assert sorted(tuple(r) for r in manifest.document_manifest(spark, sf).select(names).collect()) == sorted(want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("nodes_")]


def test_no_row_limit(spark):
    sf, name = "/root/testdata/sf0.001", "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "20")
    try:
        assert manifest.document_manifest(spark, sf).count() == 200
    finally:
        spark.conf.set(name, before)
