"""Texts in numbered chunks that ask questions of all other chunks.

A chunk holds whole documents, some megabytes of text. What a task has to know
about the rest of the corpus it asks: it sends sorted keys, packed by bucket, to
the task that has all of a bucket, and gets the answer back under its number.
Chunks are written once as a bucketed table, so an answer meets its chunk
without the texts moving again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm.arrow import released, runs, utf8
from keepset.llm.store import stored
from keepset.session import scratch_path

CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 60_000
NO_ID = -1 << 63  # a null id comes before all others
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CACHED_WORDS = 150_000
_known: dict[bytes, int] = {}


def chunked(docs: DataFrame) -> DataFrame:
    """``part, chunk, ids, tags, sizes, packed, n_bytes`` from ``id, tag, text``; the documents of a chunk ascend by id.

    Null texts are empty. ``packed`` holds the texts one after the other, compressed; ``sizes`` their bytes.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        packer = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: NO_ID if r[0] is None else r[0])
            return pa.RecordBatch.from_pylist([{
                "part": part, "chunk": number, "ids": [r[0] for r in rows], "tags": [r[1] for r in rows], "sizes": [len(r[2]) for r in rows],
                "packed": packer.compress(b"".join(r[2] for r in rows)), "n_bytes": size}], kept)

        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), utf8(batch.column("text")), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= CHUNK_BYTES or len(held) >= CHUNK_DOCS:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    kept = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.string())),
                      ("sizes", pa.list_(pa.int32())), ("packed", pa.binary()), ("n_bytes", pa.int64())])
    return bucketed(docs.select(F.col("id").cast("long").alias("id"), F.col("tag").cast("string").alias("tag"), "text").mapInArrow(
        released(work), "part int, chunk int, ids array<long>, tags array<string>, sizes array<int>, packed binary, n_bytes long"))


def bucketed(made: DataFrame) -> DataFrame:
    """Chunks, written once as a table bucketed by ``part``."""
    spark, name = made.sparkSession, f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "part").option("path", scratch_path(spark, name)).option("compression", "none").saveAsTable(name)
    return spark.table(name)


def texts_of(row: dict) -> list[bytes]:
    """The texts of a chunk."""
    raw, ends = zstandard.ZstdDecompressor().decompress(row["packed"]), np.cumsum(row["sizes"], dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def answered(chunks: DataFrame, **answers: DataFrame) -> DataFrame:
    """The chunks with a column per table of answers (``part, chunk, bucket, bits``): those to the chunk, as ``bucket, bits``."""
    columns = list(chunks.columns)
    for name, found in answers.items():
        by_part = found.groupBy("part").agg(F.collect_list(F.struct("chunk", "bucket", "bits")).alias(name))
        chunks = chunks.join(by_part.hint("shuffle_hash"), "part", "left")
        columns.append(F.expr(f"transform(filter({name}, a -> a.chunk = chunk), a -> named_struct('bucket', a.bucket, 'bits', a.bits))").alias(name))
    return chunks.select(columns)


def each_chunk(chunks: DataFrame, work: Callable[[dict], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on one chunk at a time."""
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(batch.slice(i, 1).to_pylist()[0])

    return chunks.mapInArrow(released(task), schema)


def each_bucket(rows: DataFrame, work: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """``work`` on all rows of one ``bucket`` at a time, run once."""
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            yield from work(group)

    return stored(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(task), schema), name)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word."""
    if len(_known) > _CACHED_WORDS:
        _known.clear()
    known = _known.get

    def new(word: bytes) -> int:
        _known[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    return np.array([known(w) or new(w) for w in words], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed((left ^ (left >> np.uint64(32))) * _A + right * _B)


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbours in a row, put together from halves; ``size`` - 1 shorter than ``hashes``."""
    if size == 1 or len(hashes) < size:
        return hashes[:max(len(hashes) - size + 1, 0)]
    half = size // 2
    left = rolled(hashes, half)
    n = len(hashes) - size + 1
    both = _joined(left[:n], left[half:half + n] if len(left) > half else left[:0])
    if size % 2 == 0:
        return both
    return _joined(both, hashes[size - 1:size - 1 + n])


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n).astype(bool)
