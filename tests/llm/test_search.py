import hashlib
import random
import re

import duckdb
import pytest

from keepset.llm import decontamination, merkle, sharding

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[a:a + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[a:a + n]))):
                    hit.update(range(a, a + n))
                    found |= got
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_every_document_against_the_benchmark(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert sorted((tuple(r) for r in decontamination.contaminated_documents(spark, SF).collect()), key=str) == want
    assert any(r[-1] for r in want)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_random_texts(spark, docs, slice_bytes):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))) for i in range(25)] + [(3, "a b c d"), (None, "d d d d"), (40, None), (41, "?")]
    rows = [(d, " ".join(rng.choice("abcdE,") for _ in range(rng.randrange(0, 60)))) for d in range(40)] + [(1, None), (2, ""), (None, "a b c d a b")]
    rows += rows[:3]
    benchmark = spark.createDataFrame(items * 3, "item_id long, text string")  # repeated rows are one item
    found = decontamination.contamination(docs(rows), benchmark, window=4).collect() if slice_bytes > 999 else None
    if found is None:
        hits, _ = decontamination.matches(docs(rows), benchmark, window=4, slice_bytes=slice_bytes)
        got = {(r.doc_id, k) for r in hits.collect() for k in range(r.start, r.start + r.length)}
        whole, _ = decontamination.matches(docs(rows), benchmark, window=4)
        assert got == {(r.doc_id, k) for r in whole.collect() for k in range(r.start, r.start + r.length)}
        return
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.n_hit > 0)
                  for r in found), key=str)
    assert got == brute(rows, items, 4)


def test_proximity(docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "so " + item), (2, "so " + item.replace("delta", "delta indeed")), (3, "kappa iota theta eta zeta epsilon delta gamma beta alpha"),
            (4, item.replace("delta", "delta x y z"))]
    hits, _ = decontamination.matches(docs(rows), spark.createDataFrame([(7, item)], "item_id long, text string"), slop=2)
    assert {(r.doc_id, r.kind, r.length) for r in hits.collect()} == {(1, "phrase", 10), (2, "proximity", 11)}


def test_proximity_beside_a_phrase(docs, spark):
    item = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*item[:12], "new", *item[12:]])), (2, " ".join(item)), (3, " ".join([*item[:12], "a", "b", "c", *item[12:]]))]
    hits, _ = decontamination.matches(docs(rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), slop=2)
    found = sorted((r.doc_id, r.kind, r.start, r.length) for r in hits.collect())
    across = [(1, "proximity", s, 11) for s in range(3, 12)]  # windows on both sides of the word
    assert found == sorted([(1, "phrase", 0, 12), (1, "phrase", 13, 18), *across, (2, "phrase", 0, 30), (3, "phrase", 0, 12), (3, "phrase", 15, 18)])


def test_decontamination_edges(spark, edges, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.contamination(edges, none).collect()
    assert len(found) == len(edge_rows) and not any(r.n_hit for r in found)
    some = spark.createDataFrame([(1, "two three four"), (2, "w17")], "item_id long, text string")
    kept = decontamination.keep_clean(edges, some)
    assert kept.columns == edges.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert decontamination.contamination(edges.limit(0), some).count() == 0


def test_fingerprints(spark):
    given = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    found = {r.doc_id: r for r in merkle.document_fingerprints(spark, SF).collect()}
    assert len(found) == len(given)
    likeness = []
    for k, (doc, text) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        n = len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        r = found[doc]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprint(text) and r.edited_fingerprint == merkle.fingerprint(edited)
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(after))
        assert (r.near_edited == 1) == (edited == text)
        if n > 300 and text != after and edited != text:
            likeness.append((r.near_edited, r.near_next))
    assert sum(a > 0.4 for a, _ in likeness) > 0.9 * len(likeness) and sum(b < 0.3 for _, b in likeness) > 0.9 * len(likeness)
    by_text = {}
    for doc, text in given:
        assert by_text.setdefault(text, found[doc].fingerprint) == found[doc].fingerprint
    assert len({r[:32] for r in by_text.values()}) == len(by_text)


def test_fingerprint_edges(spark, edges, edge_rows):
    run = merkle.with_neighbours(edges, merkle._compared, merkle.SCHEMA, 8).collect()
    assert len(run) == len(edge_rows)
    assert merkle.with_neighbours(edges.limit(0), merkle._compared, merkle.SCHEMA, 8).count() == 0
    single = merkle.with_neighbours(edges.where("doc_id = 4"), merkle._compared, merkle.SCHEMA, 8).collect()
    assert [(r.doc_id, r.near_next) for r in single] == [(4, 1.0)]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_neighbours_with_a_hot_id(spark, parts):
    rows = [(i, f"t{i}") for i in range(40)] + [(20, f"hot {k}") for k in range(60)] + [(None, "n1"), (None, "n2")]
    def seen(pairs):
        import pyarrow as pa
        got = list(pairs)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])], ["doc_id", "text", "after"])
    found = merkle.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), seen, "doc_id long, text string, after string", parts).collect()
    assert sorted(r.text for r in found) == sorted(t for _, t in rows)
    follow, ids, text = {r.text: r.after for r in found}, {t: i for i, t in rows}, "t39"
    walked = []
    for _ in rows:
        walked.append(ids[text])
        text = follow[text]
    assert text == "t39" and walked == sorted((i for i, _ in rows if i is not None), reverse=True) + [None, None]


def test_differing_leaves_locate_an_edit():
    paragraphs = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(30)]
    one = merkle.fingerprint("\n".join(paragraphs))
    paragraphs[12] = paragraphs[12].replace("p12w20", "changed")
    two = merkle.fingerprint("\n".join(paragraphs))
    found = merkle.differing(one, two)
    assert 1 <= len(found) <= 3 and len({(s, p) for s, p, _ in found}) == 1
    assert merkle.differing(one, one) == [] and 0.9 < merkle.likeness(one, two) < 1


@pytest.mark.parametrize("limit", [3000, 40_000, 10**9])
def test_shards_equal_sql(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted((r.doc_id, r.n_bytes, r.depth, r.shard) for r in sharding.shards(docs, limit=limit).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert found == sorted(tuple(r) for r in con.execute(sharding.oracle(limit)).fetchall())
    sizes = {}
    for _, n, _, shard in found:
        sizes.setdefault(shard, []).append(n)
    assert all(sum(n) <= limit or len(n) == 1 for n in sizes.values())


def test_equal_rows_over_the_limit(spark, edges, edge_rows):
    rows = spark.range(500).selectExpr("7L AS doc_id", "'0123456789' AS text", "id AS h").repartition(5)
    found = sharding.shards(rows, limit=100).groupBy("shard").sum("n_bytes").collect()
    assert sum(r[1] for r in found) == 5000 and max(r[1] for r in found) <= 100 and len(found) == 50
    assert sharding.shards(edges, limit=1000).count() == len(edge_rows)
    assert sharding.shards(edges.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(docs, sharding.shards(docs, limit=50_000), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 5


def test_written_shards_with_null_and_hot_ids(spark, docs, tmp_path):
    rows = [(None, "n" * 30)] * 7 + [(None, None)] + [(1, "hot" * 10)] * 40 + [(1, f"text {i} " * 4) for i in range(60)] + [(i, "x" * i) for i in range(2, 60)]
    frame = docs(rows)
    sharding.write_shards(frame, sharding.shards(frame, limit=200), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert set(back.columns) == {*frame.columns, "shard"}
    sizes = back.selectExpr("shard", "octet_length(coalesce(text, '')) AS b").groupBy("shard").sum("b").collect()
    assert max(r[1] for r in sizes) <= 200
