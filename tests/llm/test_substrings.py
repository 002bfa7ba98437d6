"""Substring dedup against a walk over all windows."""

import hashlib
import random
import re

import pytest

from keepset.llm import substrings

LEAST = -1 << 63


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_hand(rows, window):
    first, least = {}, {}
    for row, (doc, text) in enumerate(rows):
        doc, w = LEAST if doc is None else doc, words(text)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            first.setdefault((row, key), a)
            least[key] = min(least.get(key, doc), doc)
    out = []
    for row, (doc, text) in enumerate(rows):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            if least[key] < (LEAST if doc is None else doc) or first[row, key] < a:
                gone[a:a + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str)


def test_every_document(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in by_hand(rows, 20)]
    got = sorted((tuple(r) for r in substrings.deduplicated_documents(spark, sf).collect()), key=str)
    assert got == want and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("window, parts", [(2, 3), (4, 1), (4, 7), (6, 5), (10, 4)])
def test_random_texts(spark, docs, monkeypatch, window, parts):
    monkeypatch.setattr(substrings, "_BUCKET_BYTES", 300)
    monkeypatch.setattr(substrings, "_BUCKET_WINDOWS", 50)
    rng = random.Random(window * 10 + parts)
    rows = [(rng.randrange(-20, 40), " ".join(rng.choice("aabbcDé") for _ in range(rng.randrange(0, 60)))) for _ in range(60)]
    rows += [(None, "a b c a b c a b c a b"), (None, "a b c a b c a b c a b"), (3, None), (4, ""), (5, " \t\n"), (7, "a " * 400), (8, "a\x0bb\x1cc " * 50)]
    rows += rows[:4] + [(100 + i, "x y z w v u t s r q p o " + " ".join(rng.choice("abc") for _ in range(i))) for i in range(12)]
    assert rows_of(substrings.without_repeats(docs(rows).repartition(parts), window).collect()) == by_hand(rows, window)


def test_edges(spark, edges, edge_rows):
    found = substrings.without_repeats(edges, 4).collect()
    assert rows_of(found) == by_hand(edge_rows, 4)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    assert spans[6] == [(0, 12)] and spans[5] == [] and spans[9] == []
    assert substrings.without_repeats(edges.limit(0)).collect() == []
    assert substrings.without_repeats(edges.where("doc_id = 2")).select("doc_id", "n_words", "kept").collect() == [(2, 0, "")]
    with pytest.raises(ValueError):
        substrings.without_repeats(edges, 5)
