"""Substring dedup by fixed-block anchors: words of passages that already stand earlier go.

A repeat is a run of ``window`` words or more that also starts earlier: in a document
with a smaller id, or in the same document further left.

1. Reference blocks of half a window tile each document. Wherever a repeat stands, a
   whole block lies within its first window, so blocks of one copy are met by some
   rolling window of block size in the other.
2. Each chunk of documents probes with every rolling window: the distinct hashes by
   bucket, 32 bits beside the bucket, with a mark at those that are blocks here. The
   task of a bucket answers which blocks occur again anywhere. (A wrong hit of
   32 bits costs work, not correctness.)
3. Hits are extended: of each block that occurs again, all windows that begin at or before
   it and hold it whole, as far as the next block, are hashed (64 bits besides the bucket)
   and asked for again, with the least id that has them here. The answer says whether
   a document with a smaller id has it, so windows that follow each other join to maximal
   repeats.
4. The words of those windows go, judged on the input.

A passage in a third of all documents is one key per chunk, not one per document. Texts
do not move: answers come to the chunks. A document is held whole by a task.
Null texts are empty; null ids come first, as one id. Rows that share an id are documents of which none is earlier, so equal ones
keep the same words. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm.chunks import NO_ID, answered, bits, chunked, each_bucket, each_chunk, flags, mixed, rolled, texts_of, word_hashes
from keepset.llm.store import table

WINDOW = 20
_BUCKET_BYTES = 12 << 20   # of text, for the probes of one bucket
_BUCKET_WINDOWS = 1 << 20  # windows asked for in one bucket, about
_LOW = np.uint64(0xFFFFFFFF)
_LANE = np.uint64(0x5851F42D4C957F2D)
_ANSWER = "part int, chunk int, bucket int, bits binary, n long"


class _Chunk:
    """The words of a chunk and the probes and blocks among them."""

    def __init__(self, row: dict, window: int, buckets: int):
        self.row, self.window, self.block = row, window, window // 2
        self.words = [t.split() for t in texts_of(row)]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.hashes = np.concatenate([word_hashes(w) for w in self.words]) if len(self.doc) else np.empty(0, np.uint64)
        self.place = np.arange(len(self.doc))
        probes = rolled(self.hashes, self.block)
        whole = self.place[:len(probes)] + self.block <= self.ends[self.doc[:len(probes)]]
        self.probe_at = np.flatnonzero(whole)
        key = probes[whole]
        self.key = ((key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (key & _LOW)
        begin = self.ends - self.sizes
        self.is_block = (self.probe_at - begin[self.doc[self.probe_at]]) % self.block == 0
        self.distinct, counts = np.unique(self.key, return_counts=True)
        self.twice = counts > 1
        self.asked = np.zeros(len(self.distinct), dtype=bool)
        self.asked[np.searchsorted(self.distinct, self.key[self.is_block])] = True

    def probes(self) -> Iterator[pa.RecordBatch]:
        bucket = (self.distinct >> np.uint64(32)).astype(np.int64)
        for b, a, e in _spans(bucket):
            yield _row(self.row, b, keys=(self.distinct[a:e] & _LOW).astype("<u4").tobytes(), twice=bits(self.twice[a:e]), asked=bits(self.asked[a:e]))

    def windows(self, buckets: int) -> tuple[np.ndarray, ...]:
        """``start, key, bucket`` of the windows whose first block occurs again, in order of (bucket, key, start)."""
        asked = self.distinct[self.asked]
        again = _answers(self.row["blocks"], (asked >> np.uint64(32)).astype(np.int64))
        hit = np.zeros(len(self.doc) + self.block, dtype=bool)
        at = self.probe_at[self.is_block]
        hit[at] = again[np.searchsorted(asked, self.key[self.is_block])]
        begin = (self.ends - self.sizes)[self.doc]
        first = self.place + (begin - self.place) % self.block  # the first block at or after a start
        start = np.flatnonzero((self.place + self.window <= self.ends[self.doc]) & hit[np.minimum(first, len(hit) - 1)])
        key = rolled(self.hashes, self.window)[start]
        bucket = ((rolled(mixed(self.hashes ^ _LANE), self.window)[start] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((start, key, bucket))
        return start[order], key[order], bucket[order]


def _spans(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``value, begin, end`` of each run."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)]):
        if e > a:
            yield int(sorted_values[a]), a, e


def _row(row: dict, bucket: int, **binaries: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([row["chunk"]], pa.int32()),
                                       *[pa.array([v], pa.binary()) for v in binaries.values()]], ["bucket", "part", "chunk", *binaries])


def _answers(found: list[dict] | None, bucket: np.ndarray) -> np.ndarray:
    """Flags in the order asked; no answer for a bucket means none."""
    by_bucket = {a["bucket"]: a["bits"] for a in found or ()}
    out = np.zeros(len(bucket), dtype=bool)
    for b, a, e in _spans(bucket):
        if b in by_bucket:
            out[a:e] = flags(by_bucket[b], e - a)
    return out


def _answer(rows: list[dict], bucket: int, hits: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    out = [(r["part"], r["chunk"], bucket, bits(h), int(h.sum())) for r, h in zip(rows, hits, strict=True) if h.any()]
    if out:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["part", "chunk", "bucket", "bits", "n"])


def _blocks_again(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Which of the blocks asked for occur elsewhere or twice."""
    rows = group.to_pylist()
    keys = [np.frombuffer(r["keys"], dtype="<u4") for r in rows]
    twice = np.concatenate([k[flags(r["twice"], len(k))] for k, r in zip(keys, rows)])
    distinct, counts = np.unique(np.concatenate(keys), return_counts=True)
    again = np.union1d(distinct[counts > 1], twice)
    yield from _answer(rows, rows[0]["bucket"], (np.isin(k[flags(r["asked"], len(k))], again, assume_unique=True) for k, r in zip(keys, rows)))


def _windows_earlier(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Which of the windows asked for a document with a smaller id has."""
    rows = group.to_pylist()
    keys = [np.frombuffer(r["keys"], dtype="<u8") for r in rows]
    ids = [np.frombuffer(r["ids"], dtype="<i8")[np.frombuffer(r["owner"], dtype="<u2")] for r in rows]
    key, owner = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((owner, key))
    new = np.append(True, key[order][1:] != key[order][:-1])
    least = np.empty_like(owner)
    least[order] = owner[order][new][np.cumsum(new) - 1]
    yield from _answer(rows, rows[0]["bucket"], np.split(least < owner, np.cumsum([len(k) for k in keys])[:-1]))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` per document.

    ``spans`` (start, length in words) are the maximal runs of removed words, ``kept`` the others joined by one space.
    """
    if window < 2 or window % 2:
        raise ValueError("a window is an even number of words")
    chunks = chunked(docs.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("tag"), F.col(text_col).alias("text")))
    buckets = max(1, -(-(chunks.agg(F.sum("n_bytes")).first()[0] or 0) // _BUCKET_BYTES))

    def probes(row: dict) -> Iterator[pa.RecordBatch]:
        yield from _Chunk(row, window, buckets).probes()

    asked = each_chunk(chunks, probes, "bucket int, part int, chunk int, keys binary, twice binary, asked binary")
    blocks = each_bucket(asked, _blocks_again, _ANSWER, "repeated-blocks")
    wide = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) * window // 2 // _BUCKET_WINDOWS))

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(row, window, buckets)
        start, key, bucket = chunk.windows(wide)
        new = _first(key, bucket)
        ids, doc = _ids(row), chunk.doc[start[new]]
        key, bucket = key[new], bucket[new]
        for b, a, e in _spans(bucket):
            own, owner = np.unique(doc[a:e], return_inverse=True)
            yield _row(row, b, keys=key[a:e].astype("<u8").tobytes(), owner=owner.astype("<u2").tobytes(), ids=ids[own].astype("<i8").tobytes())

    again = each_chunk(answered(chunks, blocks=blocks), ask, "bucket int, part int, chunk int, keys binary, owner binary, ids binary")
    earlier = each_bucket(again, _windows_earlier, _ANSWER, "repeated-windows")

    def keep(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(row, window, buckets)
        start, key, bucket = chunk.windows(wide)
        new = _first(key, bucket)
        ids, doc = _ids(row), chunk.doc[start]
        group = np.cumsum(new) - 1
        gone = _answers(row["windows"], bucket[new])[group] if len(group) else np.empty(0, dtype=bool)
        gone |= ids[doc] > ids[doc[new]][group]
        gone[1:] |= ~new[1:] & (doc[1:] == doc[:-1])
        edge = np.zeros(len(chunk.doc) + 1, dtype=np.int64)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + window, -1)
        removed = np.cumsum(edge[:-1]) > 0
        out = []
        for doc_id, words, end in zip(row["ids"], chunk.words, chunk.ends.tolist(), strict=True):
            own = removed[end - len(words):end]
            if own.any():
                turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
                spans = [{"start": a, "length": e - a} for a, e in turns.tolist()]
                words_left = [w for w, r in zip(words, own.tolist()) if not r]
            else:
                spans, words_left = [], words
            out.append((doc_id, len(words), len(words) - len(words_left), spans, b" ".join(words_left)))
            if len(out) >= 500:
                yield _kept(out)
                out = []
        if out:
            yield _kept(out)

    return each_chunk(answered(chunks, blocks=blocks, windows=earlier), keep,
                      "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string")


def _first(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Where a new (bucket, key) begins."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    return new


def _ids(row: dict) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in row["ids"]], dtype=np.int64)


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def deduplicated_documents(spark, sf_dir: str) -> DataFrame:
    """``op13_substring_dedup``: what is left of every document without passages of 20 words that stand earlier."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
