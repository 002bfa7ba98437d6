import math
import os
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keepset.llm import chosen_path, lines
from keepset.llm.components import components
from keepset.llm.store import stored
from keepset.session import materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, size):
    """All pairs of sets that share a shingle, exactly."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    pairs = set()
    for k, (d, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < k:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j][1]) - c):
                pairs.add((d, sets[j][0]))
    return union(pairs, [d for d, _ in rows]), {d: len(s) for d, s in sets}


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    pairs += [(1000, i) for i in range(1001, 1100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs + pairs[:50], "u long, v long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert {n: c for n, c in want.items() if n != c} == found
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_of_the_documents(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    component, n = brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], size)
    found = chosen_path.near_duplicates(docs, size).collect()
    assert {r.doc_id: r.component_id for r in found} == component
    assert {r.doc_id: r.n_shingles for r in found} == n
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_groups_are_split_and_nothing_is_lost(spark, monkeypatch):
    """Near copies at many distances; nodes of at most 8, so branching and block pairs take place."""
    monkeypatch.setattr(chosen_path, "NODE", 8)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((d, " ".join(w)))
    rows += [(200 + d, " ".join(base[:30] + [f"y{rng.randrange(9999)}" for _ in range(90)])) for d in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    component, _ = brute_components(rows, 4)
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(frame, 4).collect()} == component


def test_near_duplicate_edges(spark, edges, edge_rows):
    found = chosen_path.near_duplicates(edges, 4).collect()
    assert len(found) == len(edge_rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}
    assert got[None][1:] == (None, True) and got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[5] == (9, 5, True) and got[6] == (9, 5, False)
    kept = chosen_path.keep_first(edges)
    assert kept.columns == edges.columns and kept.count() == len(edge_rows) - 1
    assert chosen_path.near_duplicates(edges.limit(0)).count() == 0
    several = spark.createDataFrame([(1, "a b c d e"), (1, "f g h i j"), (2, "f g h i j"), (3, "A b c d e")], "doc_id long, text string")
    assert {r.component_id for r in chosen_path.near_duplicates(several, 4).collect()} == {1}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(t) + 1), rng.random()
        if kind < 0.4:
            t.insert(i, rng.choice("abcé"))
        elif i < len(t):
            if kind < 0.7:
                t[i] = rng.choice("abcé")
            else:
                del t[i]
    return "".join(t)


def test_banded_distance():
    rng = random.Random(1)
    for t in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.choice([0, 2, 5, 20] if t % 20 else [70, 140])))
        b = edited(rng, a, rng.randrange(5)) if t % 7 else "".join(rng.choice("abc") for _ in range(len(a)))
        for edits in (1, 2, 3):
            assert lines.within(a, b, edits) == (distance(a, b) <= edits)


def test_distances_of_many_pairs():
    rng = random.Random(4)
    one, two, edits = [], [], []
    for t in range(5000):
        a = "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 20, 45, 70, 140])))
        b = edited(rng, a, rng.randrange(14)) if t % 7 else "".join(rng.choice("abc") for _ in range(len(a)))
        one.append(b if t % 2 else a), two.append(a if t % 2 else b), edits.append(rng.choice([0, 1, 2, 3, 5, 7, 20, 31, 40]))
    want = [lines.within(a, b, k) for a, b, k in zip(one, two, edits)]
    assert lines.within_each(one, two, np.array(edits)).tolist() == want and 1000 < sum(want) < 4500
    assert lines.within_each([], [], np.array([], dtype=np.int64)).tolist() == []


def test_parities_change_by_four_an_edit():
    rng = random.Random(6)
    for _ in range(300):
        a = "".join(rng.choice("abcdé𝄞 ") for _ in range(rng.choice([20, 60, 300])))
        n = rng.randrange(5)
        both = sorted([a, edited(rng, a, n)], key=len)
        odd = lines.signatures(both, 2, False)[3].view(np.uint64)
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= 4 * n


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_classes_against_all_pairs(spark, edits):
    rng = random.Random(edits)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(18, 60))).strip() + "z" for _ in range(25)]
    rows = [(d, "\n".join(edited(rng, rng.choice(bases), rng.randrange(0, edits + 2)) for _ in range(4)) + "\nshort") for d in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    place, kept = {}, defaultdict(list)
    for d, t in rows:
        for k, line in enumerate(t.split("\n")):
            line = line.strip()
            if len(line) >= lines.MIN_CHARS:
                kept[line].append((d, k))
    distinct = sorted(kept)
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    component, degree = union(pairs, distinct), defaultdict(int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    first = {}
    for line, at in kept.items():
        first[component[line]] = min(first.get(component[line], min(at)), min(at))
    want = {p: (first[component[line]], degree[line]) for line, at in kept.items() for p in at}
    found = {(r.doc_id, r.line_no): ((r.class_doc, r.class_line), r.n_links) for r in lines.line_classes(frame, edits).collect()}
    assert len(pairs) > 20 and found == want


def test_dense_keys_are_compared_in_blocks(spark, monkeypatch):
    """Near copies of one line at many distances, with every key dense and many blocks, against all pairs."""
    monkeypatch.setattr(lines, "_DENSE", 30)
    monkeypatch.setattr(lines, "_BLOCK", 16)
    monkeypatch.setattr(lines, "_GRID", 100)
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n - 2)).join("xy") for n in (30, 64, 150)]
    texts = [edited(rng, base, rng.randrange(10)) for base in bases for _ in range(100)]
    texts += [edited(rng, "ab" * n, rng.randrange(4)) for n in (30, 31, 75) for _ in range(30)]  # the same window at many places
    distinct = sorted({t.strip() for t in texts})
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i]
             if abs(len(a) - len(b)) <= 7 and distance(a, b) <= lines.allowed(min(len(a), len(b)), None)]
    component, degree = union(pairs, distinct), defaultdict(int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    first = {}
    for d, t in enumerate(texts):
        first.setdefault(component[t.strip()], d)
    found = {r.doc_id: (r.class_doc, r.n_links) for r in lines.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()}
    assert len(pairs) > 1000 and found == {d: (first[component[t.strip()]], degree[t.strip()]) for d, t in enumerate(texts)}


def test_lines_with_dense_keys_stand_in_one_block_each(spark, monkeypatch):
    """Lines are not copied for each of their keys: blocks with a key in common meet once, however many keys they share."""
    monkeypatch.setattr(lines, "_BLOCK", 16)
    rng = random.Random(2)
    rows = [(place, 50, [7, *rng.sample(range(100, 140), 8)], [7, *rng.sample(range(100, 140), 5)] if place % 3 else None) for place in range(120)]
    rows += [(place, 50, None if place % 2 else [9], [9]) for place in range(200, 230)]
    dense = spark.createDataFrame(rows, "place long, size int, dense_probes array<long>, dense_segments array<long>")
    placed = lines._blocks(dense).collect()
    block = {r.place: r.block for r in placed}
    assert len(placed) == len(block) == len(rows) and 8 <= len(set(block.values())) <= 12
    met = [tuple(r) for r in lines._met_blocks(dense.join(spark.createDataFrame(list(block.items()), "place long, block long"), "place")).collect()]
    want = {tuple(sorted((block[p], block[q]))) for p, _, probes, _ in rows for q, _, _, segments in rows if set(probes or ()) & set(segments or ())}
    assert len(met) == len(set(met)) <= 2 * len(want) and {(a, b) for _, a, b in met} == want
    assert all({x for x, *pair in met if tuple(pair) == (a, b)} == {a, b} for a, b in want)


def test_a_bucket_tells_each_chunk_its_pairs():
    """Only lengths that go together, also where two bytes cannot tell a length, and no pair under a dense key."""
    def row(part, n_index, entries):
        keys, owners, sizes = (np.array(x) for x in zip(*entries))
        return {"bucket": 0, "part": part, "chunk": 0, "n_index": n_index, "keys": keys.astype("<u4").tobytes(), "lines": owners.astype("<u4").tobytes(),
                "sizes": sizes.astype("<u2").tobytes()}

    top = lines._LONGEST
    table = pa.Table.from_pylist([row(3, 4, [(5, 0, 200), (6, 1, 200), (8, 2, top), (9, 3, 200), (5, 0, 200), (8, 2, top)]),
                                  row(1, 2, [(7, 0, 100), (9, 2, 200), (5, 1, 207), (6, 2, 208), (7, 3, 100), (8, 4, top), (9, 0, 200), (9, 5, 300)])])
    told = {a["part"]: lines._told([a]) for batch in lines._met(table, 4, None) for a in batch.to_pylist()}
    place = 3 << lines._PART
    assert told[1][0].tolist() == [9] and told[3][0].tolist() == [9]
    assert list(zip(told[1][2].tolist(), told[1][3].tolist())) == [(1, place), (3, 1 << lines._PART), (4, place | 2)]
    assert told[1][1].tolist() == [0, 1, 2, 3, 4, 5] and told[3][1].tolist() == [0, 2, 3] and not len(told[3][2])


def test_lines_longer_than_two_bytes_tell(spark):
    rng = random.Random(12)
    base = "x" + "".join(rng.choice("abcdefgh ") for _ in range(lines._LONGEST - 30)) + "y"
    texts = [base, base + "z" * 60, base[:40000] + base[40090:], base[:300] + base[600:], base[:30000]]
    found = {r.doc_id: (r.class_doc, r.n_links) for r in lines.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()}
    assert [lines.within(texts[i], texts[j], 127) for i, j in ((0, 1), (0, 2), (1, 2), (0, 3))] == [True, True, False, False]
    assert found == {0: (0, 2), 1: (0, 1), 2: (0, 1), 3: (3, 0), 4: (4, 0)}


def test_lines_dropped(spark, docs, edges, edge_rows):
    a, b = "this line is long enough to count here", "another line that is long enough too"
    rows = [(1, f"{a}\nhead\n{b}"), (2, f"head\n{a[:-1]}\nnothing like the others, all alone"), (3, f"{b}\n  {a}  "), (4, None), (5, ""), (6, "head")]
    found = {r.doc_id: r for r in lines.drop_repeated_lines(docs(rows)).collect()}
    assert {d: r.text for d, r in found.items()} == {1: rows[0][1], 2: "head\nnothing like the others, all alone", 4: None, 5: "", 6: "head"}
    assert found[2].n_chars == len(found[2].text) and found[1].lang == "en"
    left = lines.drop_repeated_lines(edges)
    assert left.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(d or 0 for d, _ in edge_rows if d != 6)
    assert lines.line_classes(edges.limit(0)).count() == 0


def test_short_lines_take_part_by_equality(spark, docs, tmp_path):
    rows = [(1, "Les.\nonly here\n\nLes."), (2, " Les.\nLes,\na line that is long enough for the edit join"), (3, "Les.\n"), (4, None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.n_links, r.kept) for r in lines.document_lines(spark, str(tmp_path)).collect()}
    assert found == {(1, 0): (1, 0, 0, True), (1, 1): (1, 1, 0, True), (1, 3): (1, 0, 0, False), (2, 0): (1, 0, 0, False),
                     (2, 1): (2, 1, 0, True), (2, 2): (2, 2, 0, True), (3, 0): (1, 0, 0, False)}
    left = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs(rows), "").collect()}
    assert left == {1: "Les.\nonly here\n", 2: "Les,\na line that is long enough for the edit join", 4: None}


def test_edits_grow_with_the_length(spark):
    """All pairs by hand; lengths around the borders of bands, and a pair too far apart for 64 rows."""
    rng = random.Random(9)
    rows, n = [], 0
    for size in [20, 35, 36, 37, 63, 64, 66, 99, 100, 143, 144, 147, 200, 256, 259, 400, 500]:
        base = "".join(rng.choice("abcdefgh ") for _ in range(size - 2)).replace("  ", "ab")
        base = "x" + base + "y"
        for e in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12):
            rows.append((n := n + 1, edited(rng, base, e)))
    distinct = sorted({t.strip() for _, t in rows if len(t.strip()) >= lines.MIN_CHARS})
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i]
             if abs(len(a) - len(b)) <= 13 and distance(a, b) <= max(2, math.floor(math.sqrt(min(len(a), len(b))) / 2))]
    degree = defaultdict(int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    texts = dict(rows)
    found = {texts[r.doc_id].strip(): r.n_links for r in lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    assert len(pairs) > 100 and found == {t: degree[t] for t in distinct}
    assert any(distance(a, b) > 2 for a, b in pairs)
    for edits in (31, 32, 40, 80):
        a = "".join(rng.choice("abcd") for _ in range(400))
        b = edited(rng, a, edits + 15)
        assert lines.within(a, b, edits) == (distance(a, b) <= edits)


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {file for top in dirs for _, _, files in os.walk(top.getPath()) for file in files if file.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = shuffle_files(spark), spark.conf.get(setting)
    made = stored(sums, "left-behind"), materialize(sums)
    assert spark.conf.get(setting) == given
    for _ in range(100):  # the files go a little after the run
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and [table.count() for table in made] == [7, 7]
    assert shuffle_files(spark) - before  # a run outside keeps its own


def test_texts_are_told_for_pairs_that_may_be_linked_only(spark, monkeypatch):
    rng, n = random.Random(9), 60
    # every two of these share a segment, but only the first two are alike
    tail = "the same last words of every one of these lines"
    rows = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) + tail for _ in range(n)]
    rows[1] = "?" + rows[0][1:]
    found, asked = [], []
    candidates, texts = lines._candidates, lines._texts
    monkeypatch.setattr(lines, "_candidates", lambda *a: found.append(spark.createDataFrame((t := candidates(*a)).collect(), t.schema)) or t)
    monkeypatch.setattr(lines, "_texts", lambda chunks, places: asked.extend(texts(chunks, places).collect()) or texts(chunks, places))
    links = lines.line_links(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), None).collect()
    key = {"%016X-%016X" % tuple(half & (1 << 64) - 1 for half in lines.key128(row)): row for row in rows}
    assert [{key[r.u], key[r.v]} for r in links if r.v] == [set(rows[:2])]
    held = found[0].where("other IS NULL").collect()
    assert len(held) > 50 and all((r.text is not None) == (r.dense_probes is not None or r.dense_segments is not None) for r in held)
    assert {(r.name, r.text) for r in asked} >= {(k, row) for k, row in key.items() if row in rows[:2]} and len(asked) < 20
    assert all(key[r.name] == r.text for r in asked)


def test_chunks_go_before_the_documents_are_joined(spark, docs, monkeypatch):
    made, taken = [], lines._line_chunks
    monkeypatch.setattr(lines, "_line_chunks", lambda *a: made.append(taken(*a)) or made[-1])
    line = "a line that is long enough to take part in the join"
    kept = lines.drop_repeated_lines(docs([(1, line + "\nfirst"), (2, line + "\nsecond"), (3, line + "!")]))
    folder = made[0].inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert not os.path.exists(folder)
    assert {r.doc_id: r.text for r in kept.collect()} == {1: line + "\nfirst", 2: "second"}
