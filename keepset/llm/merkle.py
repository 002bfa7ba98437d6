"""Document fingerprints: a Merkle tree over words runs, paragraphs and sections.

Leaves are runs of a few words, cut where a hash of two neighbouring words says
so, so the same passage gives the same leaves wherever it stands. Leaves make a
paragraph (a line), paragraphs make a section (cut by a hash as well), and the
root is a digest over the sections. A fingerprint is the written tree::

    root / section - paragraph - paragraph / section - ...

where a section's digest is 8 hex digits, and a paragraph is its leaves, 6 hex
digits each. Equal roots mean equal texts; else ``differing`` walks only into
sections whose digests differ and names the changed leaves, and ``likeness`` is
the share of leaves in common (twice the common ones over all).

Null texts count as empty (no sections). Texts under 256 characters have one
leaf per word or two, longer ones one per six words on average. Work is one pass
in the order of ids; a task holds two documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm.arrow import texts
from keepset.llm.store import table

SHORT = 256
LEAF_WORDS = 6
SECTION_PARAGRAPHS = 4
_WORDS = re.compile(r"\S+\s*|\s+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, dtype=np.uint64))
_HASHES: dict[str, int] = {}
_CACHED_WORDS = 150_000


def _word_hash(word: str) -> int:
    """64 bits; the lowest says whether a line ends with this word."""
    if len(_HASHES) > _CACHED_WORDS:
        _HASHES.clear()
    _HASHES[word] = found = xxhash.xxh3_64_intdigest(word) & ~1 | ("\n" in word)
    return found


def _folded(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One well mixed hash per run of values; order matters within a run."""
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    powers = _POWERS[place] if len(values) <= len(_POWERS) else _POWERS[place % len(_POWERS)] + place.astype(np.uint64) * _MIX
    total = np.add.reduceat((values ^ (values >> np.uint64(29))) * powers, starts)
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return total ^ (total >> np.uint64(29))


def fingerprint(text: str) -> str:
    """The written tree of a text."""
    words = _WORDS.findall(text)
    if not words:
        return hashlib.blake2b(b"", digest_size=16).hexdigest()
    known = _HASHES.get
    hashes = np.array([known(w) or _word_hash(w) for w in words], dtype=np.uint64)
    line_end = (hashes & np.uint64(1)).astype(bool)
    step = np.uint64(1 if len(text) < SHORT else LEAF_WORDS)
    pair = hashes * np.uint64(3)
    pair[1:] += hashes[:-1]
    leaf_end = ((pair * _MIX) >> np.uint64(40)) % step == 0
    leaf_end |= line_end
    leaf_end[-1] = line_end[-1] = True
    leaf_starts = np.append(0, np.flatnonzero(leaf_end)[:-1] + 1)
    leaves = _folded(hashes, leaf_starts)
    line_ends = np.flatnonzero(line_end[leaf_end])  # the last leaf of each paragraph
    paragraph_starts = np.append(0, line_ends[:-1] + 1)
    paragraphs = _folded(leaves, paragraph_starts)
    section_end = (paragraphs >> np.uint64(20)) % np.uint64(SECTION_PARAGRAPHS) == 0
    section_end[-1] = True
    section_starts = np.append(0, np.flatnonzero(section_end)[:-1] + 1)
    sections = _folded(paragraphs, section_starts)
    hexed = (leaves >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
    names = (sections >> np.uint64(32)).astype(">u4").tobytes().hex()
    lines = [hexed[6 * a:6 * b] for a, b in zip(paragraph_starts.tolist(), (line_ends + 1).tolist(), strict=True)]
    ends = [*section_starts[1:].tolist(), len(lines)]
    root = hashlib.blake2b(sections.tobytes(), digest_size=16).hexdigest()
    return root + "".join(f"/{names[8 * i:8 * i + 8]}-{'-'.join(lines[a:b])}"
                          for i, (a, b) in enumerate(zip(section_starts.tolist(), ends, strict=True)))


def _leaves(tree: str) -> list[str]:
    return [line[i:i + 6] for section in tree.split("/")[1:] for line in section.split("-")[1:]
            for i in range(0, len(line), 6)]


def likeness(one: str, two: str) -> float:
    """1 for equal roots, else the share of common leaves: 0 if none."""
    if one[:32] == two[:32]:
        return 1.0
    a, b = _leaves(one), _leaves(two)
    if not a or not b:
        return 0.0
    held = Counter(a)
    common = 0
    for leaf in b:
        if held.get(leaf, 0):
            held[leaf] -= 1
            common += 1
    return min(2.0 * common / (len(a) + len(b)), 1.0 - 1e-9)


def differing(one: str, two: str) -> list[tuple[int, int, int]]:
    """Where the first tree holds leaves the second lacks: ``(section, paragraph, leaf)``.

    Sections found in the second tree by their digest are not opened.
    """
    if one[:32] == two[:32]:
        return []
    other = {section[:8] for section in two.split("/")[1:]}
    left = Counter(leaf for section in two.split("/")[1:] for line in section.split("-")[1:]
                   for leaf in (line[i:i + 6] for i in range(0, len(line), 6)))
    found = []
    for s, section in enumerate(one.split("/")[1:]):
        if section[:8] in other:
            continue
        for p, line in enumerate(section.split("-")[1:]):
            for k in range(len(line) // 6):
                leaf = line[6 * k:6 * k + 6]
                if left[leaf] > 0:
                    left[leaf] -= 1
                else:
                    found.append((s, p, k))
    return found


def fingerprints(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with their fingerprint as one more column."""

    @F.pandas_udf("string")
    def tree(column: pd.Series) -> pd.Series:
        return column.map(lambda t: fingerprint(t or ""))

    return df.withColumn(name, tree(F.col(text_col)))


def with_neighbours(df: DataFrame, work, schema: str, parts: int) -> DataFrame:
    """``work(rows)`` over all rows in descending order of id, each paired with the next.

    ``rows`` yields ``(doc_id, text, next_text)``; after the last row comes the
    first. The ids are cut at quantiles, an id that fills several quantiles
    further by a hash of its text, and the first row of each part is also sent
    to the part before it: one shuffle of the texts, no task sees more than its
    part. Rows of one id follow in the order of the hash; null ids come last.
    """
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = source.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    cuts = np.sort(np.array(cuts or [], dtype=np.int64))[::-1]

    @F.pandas_udf("int")
    def dealt(ids: pd.Series, none: pd.Series, share: pd.Series) -> pd.Series:
        above = len(cuts) - np.searchsorted(cuts[::-1], ids.to_numpy(), side="right")
        same = len(cuts) - np.searchsorted(cuts[::-1], ids.to_numpy(), side="left") - above
        known = above + np.floor(share.to_numpy() * (same + 1))
        return pd.Series(np.where(none, len(cuts) + 1 + np.floor(share.to_numpy() * 16), known).astype(np.int32))

    place = F.shiftrightunsigned("hash", 11)
    part = dealt(F.coalesce("doc_id", F.lit(0).cast("long")), F.isnull("doc_id"), place / F.lit(float(1 << 53)))
    keyed = source.withColumn("hash", F.xxhash64("text"))
    keyed = keyed.withColumn("part", part)
    order = F.struct(F.isnull("doc_id").alias("none"), F.bitwise_not("doc_id").alias("down"), place.alias("hash"))
    first = source.select("doc_id", F.xxhash64("text").alias("hash")).withColumn("part", part)
    heads = sorted((r["part"], r["doc_id"], r["hash"]) for r in
                   first.groupBy("part").agg(F.min_by(F.struct("doc_id", "hash"), order).alias("r")).select("part", "r.*").collect())
    if not heads:
        return df.sparkSession.createDataFrame([], schema)
    before = [(doc, h, heads[i - 1][0]) for i, (_, doc, h) in enumerate(heads)]
    spark = df.sparkSession
    sent = spark.createDataFrame(before, "head_id long, head_hash long, before int")
    tails = (keyed.join(F.broadcast(sent), F.expr("doc_id <=> head_id AND hash = head_hash"))  # one row for each part
             .groupBy("before").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
             .select("doc_id", "text", F.lit(0).cast("long").alias("hash"), F.col("before").alias("part"), F.lit(True).alias("tail")))
    rows = keyed.select("doc_id", "text", "hash", "part", F.lit(False).alias("tail")).union(tails)
    rows = (rows.repartition("part")
            .sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), place))

    def pairs(batches: Iterable[pa.RecordBatch]):
        held = None
        for batch in batches:
            for doc, text, tail in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")),
                                       batch.column("tail").to_pylist(), strict=True):
                if held is not None:
                    yield (*held, text)
                held = None if tail else (doc, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(pairs(batches))

    return rows.mapInArrow(run, schema)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compared(rows) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    names = [column.split()[0] for column in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        out.clear()
        return batch

    after = (None, None)
    for doc, text, other in rows:
        n = len(text)
        edited = text[:n - n // 3] + other[:n // 3]
        own = after[1] if after[0] is not None and after[0] == text else fingerprint(text)
        changed = own if edited == text else fingerprint(edited)
        after = (other, fingerprint(other))
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed),
                    likeness(own, after[1])))
        if len(out) >= 2000:
            yield flush()
    if out:
        yield flush()


def document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """``op7_fingerprints``: every document, its edited text and the next document compared."""
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return with_neighbours(table(spark, sf_dir, "documents"), _compared, SCHEMA, parts)
