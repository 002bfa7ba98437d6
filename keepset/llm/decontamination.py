"""Benchmark decontamination with a distributed positional inverted index.

1. Document frequencies of the benchmark's terms are counted over all documents.
2. Each window of an item (``WINDOW`` words in a row; a shorter item is one window)
   is looked for by its two rarest terms. The index holds the postings of those
   terms: (term, document, positions), written once to the shared folder.
3. Postings are shifted by the term's offset in the item. Where two of a window's
   rare terms agree on the shift, the window may stand there. That is a grouping by
   (document, item, shift), spread over as many keys as there are occurrences.
4. The documents found so are read once more and every word of the item is held
   against the text at that shift: exact phrases. With ``slop``, shifts may differ
   by so many words, and windows that no phrase at that shift covers and whose words
   stand in order within that slack are returned as proximity matches.

The benchmark is worked off in slices of at most ``SLICE_BYTES``, so what goes to
the tasks is bounded; the documents are never shuffled whole, only those that have
candidates.

Null texts have no words, and neither has an item without words any window. Items
of one id count once; items with a null id hit words but are not listed. Repeated
rows each get the same result. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm import bloom
from keepset.llm.arrow import released, utf8
from keepset.llm.store import free_name, stored, table

WINDOW = 10
SLICE_BYTES = 1 << 20
#: A-Z lowered; ASCII other than letters and digits separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Items:
    """One slice of the benchmark: items as term numbers, their windows, and who uses which window."""

    def __init__(self, rows: list[tuple], window: int):
        self.window = window
        self.terms: dict[bytes, int] = {}
        by_words: dict[tuple, set] = {}
        for item, text in rows:
            found = words((text or "").encode())
            if found:
                by_words.setdefault(tuple(found), set()).add(item)
        self.ids = [sorted(ids, key=lambda i: (i is None, str(i))) for ids in by_words.values()]
        self.words = list(by_words)
        for found in self.words:
            for w in found:
                self.terms.setdefault(w, len(self.terms))

    def windows(self, item: int) -> list[tuple[int, int]]:
        n = len(self.words[item])
        return [(0, n)] if n <= self.window else [(a, self.window) for a in range(n - self.window + 1)]

    def anchors(self, frequency: np.ndarray) -> list[tuple[int, int, int]]:
        """``(term, item, offset)`` of the two rarest places of each window whose terms all occur somewhere."""
        chosen = set()
        for item, found in enumerate(self.words):
            rank = [(int(frequency[self.terms[w]]), self.terms[w], k) for k, w in enumerate(found)]
            for start, n in self.windows(item):
                places = sorted(rank[start:start + n])
                if places[0][0]:
                    chosen.update((term, item, k) for _, term, k in places[:2])
        return sorted(chosen)


def _frequencies(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros(len(terms), dtype=np.int64), terms.keys()
        for batch in batches:
            for text in utf8(batch.column("text")):
                for w in known & set(words(text)):
                    held[terms[w]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for r in docs.select("text").mapInArrow(released(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]  # at most one row per term of the slice
    return out


def _index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``key, doc_id, term, positions``; and for each row ``term`` -1 with its number of words."""
    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, positions = [], [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                found = words(text)
                row.append(i), term.append(-1), positions.append([len(found)])
                at: dict[int, list[int]] = {}
                for k, t in enumerate(map(terms.get, found)):
                    if t is not None:
                        at.setdefault(t, []).append(k)
                for t, places in at.items():
                    row.append(i), term.append(t), positions.append(places)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int32())), batch.column("doc_id").take(pa.array(row, pa.int32())),
                                              pa.array(term, pa.int32()), pa.array(positions, pa.list_(pa.int32()))],
                                             ["key", "doc_id", "term", "positions"])

    return docs.mapInArrow(released(post), f"key long, doc_id {dict(docs.dtypes)['doc_id']}, term int, positions array<int>")


def _runs(equal: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``need`` true values: (start, length)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= need]


def _near(found: list[bytes], wanted: tuple, start: int, n: int, shift: int, slop: int) -> tuple[int, int] | None:
    """The window's words in order near its shifted place, within ``n + slop`` words."""
    for first in range(max(0, shift + start - slop), min(len(found), shift + start + slop + 1)):
        if found[first] != wanted[start]:
            continue
        k = 1
        for at in range(first + 1, min(len(found), first + n + slop)):
            if k < n and found[at] == wanted[start + k]:
                k += 1
            if k == n:
                return first, at + 1 - first
        if n == 1:
            return first, 1
    return None


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = 0,
            slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Matches ``key, doc_id, item_id, start, length, kind`` and rows ``key, doc_id, n_words``.

    A match is the longest stretch of document words covered by windows of one item at
    one place. ``key`` is a hash of id and text; equal rows share it.
    """
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    benchmark = benchmark.select("item_id", "text").distinct()  # a row repeated many times is one item
    item_type = dict(benchmark.dtypes)["item_id"]
    schema = f"key long, doc_id {dict(docs.dtypes)['doc_id']}, item_id {item_type}, start int, length int, kind string"
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + total // (slice_bytes // 2)  # hashed, so a slice rarely exceeds the bound and never by much
    found, rows = None, None
    for s in range(slices):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        items = Items([tuple(r) for r in part.collect()], window)
        frequency = _frequencies(docs, items.terms) if items.terms else np.zeros(0, dtype=np.int64)
        anchors = items.anchors(frequency)
        used = {t for t, *_ in anchors}
        index = stored(_index(docs, {w: t for w, t in items.terms.items() if t in used}), "postings")
        if rows is None:
            rows = index.where("term = -1").select("key", "doc_id", F.element_at("positions", 1).cast("long").alias("n_words"))
        if anchors:
            new = _verified(docs, _candidates(index, anchors, items, slop), items, slop, schema)
            found = new if found is None else found.union(new)
    return (docs.sparkSession.createDataFrame([], schema) if found is None else found), rows


def _candidates(index: DataFrame, anchors: list[tuple], items: Items, slop: int) -> DataFrame:
    """``key, at``: the items and shifts at which each document may hold a window."""
    offsets = index.sparkSession.createDataFrame(anchors, "term int, item int, off int")  # bounded by the slice
    placed = (index.where("term >= 0").dropDuplicates(["key", "term"]).join(F.broadcast(offsets), "term")
              .select("key", "item", "off", F.explode("positions").alias("position"))
              .withColumn("shift", F.col("position") - F.col("off")))
    single = [i for i, w in enumerate(items.words) if len(w) == 1]
    if slop:
        met = placed.groupBy("key", "item").agg(F.collect_set("shift").alias("shifts"), F.count_distinct("off").alias("n"))
        met = met.select("key", "item", F.explode("shifts").alias("shift"), "n")
    else:
        met = placed.groupBy("key", "item", "shift").agg(F.count_distinct("off").alias("n"))
    met = met.where((F.col("n") > 1) | F.col("item").isin(single)) if single else met.where("n > 1")
    return met.groupBy("key").agg(F.collect_list(F.struct("item", "shift")).alias("at"))


def _verified(docs: DataFrame, candidates: DataFrame, items: Items, slop: int, schema: str) -> DataFrame:
    candidates = stored(candidates, "candidates")
    filter_words = bloom.build(candidates, "key")

    def maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.contains(filter_words, batch.column("key").to_numpy())))

    some = docs.mapInArrow(maybe, docs.schema).dropDuplicates(["key", "doc_id"]).join(candidates, "key")
    fields = [f.strip().split()[0] for f in schema.split(",")]

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, item, start, length, kind = [], [], [], [], []
            for i, (text, at) in enumerate(zip(utf8(batch.column("text")), batch.column("at").to_pylist(), strict=True)):
                found, seen = words(text), set()
                for place in at:
                    j, shift = place["item"], place["shift"]
                    wanted = items.words[j]
                    a, b = max(0, -shift), min(len(wanted), len(found) - shift)
                    equal = np.fromiter((found[shift + k] == wanted[k] for k in range(a, b)), dtype=bool, count=max(0, b - a))
                    hits = [(shift + a + s, n, "phrase") for s, n in _runs(equal, min(items.window, len(wanted)))]
                    if slop:
                        exact = [(first - shift, first - shift + n) for first, n, _ in hits]
                        rest = [(s, n) for s, n in items.windows(j) if not any(a <= s and s + n <= e for a, e in exact)]
                        near = ((_near(found, wanted, s, n, shift, slop), n) for s, n in rest)
                        hits += [(*hit, "proximity") for hit, n in near if hit and hit[1] > n]  # without a gap it is a phrase at another shift
                    for hit in hits:
                        if (j, hit) not in seen:
                            seen.add((j, hit))
                            for name in items.ids[j]:
                                row.append(i), item.append(name), start.append(hit[0]), length.append(hit[1]), kind.append(hit[2])
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("doc_id").take(take), pa.array(item, item_arrow),
                                              pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(kind, pa.string())], fields)

    item_arrow = pa.int64() if re.search(r"item_id (bigint|long)", schema) else pa.int32() if "item_id int" in schema else pa.string()
    return some.mapInArrow(verify, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` for each row, from exact phrases."""
    found, rows = matches(docs, benchmark, window=window)
    spans = F.transform(F.collect_list(F.struct("start", "length")), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    per_doc = found.groupBy("key", F.col("doc_id").alias("hit_id")).agg(
        F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    joined = rows.alias("r").join(per_doc.alias("p"), F.expr("r.key = p.key AND r.doc_id <=> p.hit_id"), "left")
    return joined.select("r.key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                         F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contaminated_documents(spark, sf_dir: str) -> DataFrame:
    """``op10_decontamination``: every document against the whole benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any exact phrase of the benchmark, all columns kept."""
    found, _ = matches(docs, benchmark)
    key, doc = (free_name(n, docs.columns) for n in ("hit_key", "hit_doc"))
    hit = found.select(F.col("key").alias(key), F.col("doc_id").alias(doc)).distinct()
    keyed = (F.xxhash64("doc_id", "text") == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    return docs.join(hit, keyed, "left_anti").select(docs.columns)
