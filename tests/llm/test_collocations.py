"""Phrases against counts of all n-grams, and the quicksort against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from keepset.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    within = Counter()
    for (lang, w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = (lang, w[i:i + k])
                within[key] = max(within[key], c)
    out = {}
    for (lang, w), a in often.items():
        if 100 * within[lang, w] >= 80 * a:
            continue
        best = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        l, r = f[lang, w[:best[1]]], f[lang, w[best[1]:]]
        out.setdefault(lang, []).append((-best[0], -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("".join(rng.choice(["a ", "b ", "B\t", "é ", "C\x0b", "d, ", "e. ", "f\n", "g\x1c ", "h i "]) for _ in range(rng.randrange(0, 80))), rng.choice(["en", "en", "en", "de", None]))
           for _ in range(150)]
    out += [("New York City is New York City", "en")] * 30 + [("hot pair " * 300, "en"), (None, "en"), ("", None), (" \t ", "de"), ("x" * 100_000 + " y", "de"), ("und one und one", "und")]
    return out + out[:20]


@pytest.mark.parametrize("least, top, hot, buckets", [(5, 2000, 1 << 18, 12 << 20), (5, 2000, 8, 500), (12, 7, 40, 2000), (300, 50, 1, 12 << 20)])
def test_equals_counting_all(spark, rows, monkeypatch, least, top, hot, buckets):
    monkeypatch.setattr(collocations, "_BUCKET_BYTES", buckets)
    docs = spark.createDataFrame([(t, lang, i, "x") for i, (t, lang) in enumerate(rows)], "text string, lang string, n long, phrase string").repartition(5)
    found = collocations.collocations(docs, least, top, hot_rows=hot).select(NAMES).collect()
    assert sorted(tuple(r) for r in found) == by_hand(rows, least, top)
    assert found or least == 300


def test_no_documents(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({collocations.oracle()})").fetchall()
    assert sorted(tuple(r) for r in collocations.document_collocations(spark, sf).select(NAMES).collect()) == sorted(want) and want


@pytest.mark.parametrize("seed", range(6))
def test_quicksort(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 400))
    rows = rng.integers(0, 2 + seed * 3, (n, 4))
    for row, end in zip(rows, rng.integers(1, 5, n)):
        row[end:] = -1
    weight, want = rng.integers(1, 9, n), Counter()
    for row, w in zip(rows.tolist(), weight.tolist()):
        for d in range(1, 5):
            if row[d - 1] >= 0:
                want[tuple(row[:d])] += w
    got = [(tuple(rows[row][:depth].tolist()), count) for depth, row, count in collocations.sorted_counts(list(rows.T), weight, 10)]
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if v >= 10}
