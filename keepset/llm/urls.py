"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule allows train one model, URLs that a rule blocks the other.
Each is a variable-order Markov model over bytes: a context's counts are mixed
with the next shorter context's prediction in proportion to how little was seen
(a Dirichlet prior of ``PRIOR`` counts), so unseen contexts fall back to shorter
ones. Every context and byte has its own count, summed over every ruled URL of
the table; the counts are a distributed table that grows with the input, and
chunks of URLs look up in it what they need. The score is the difference of
log-likelihoods over the length. One in five ruled URLs is kept out of the
counts, and the threshold is the score that best parts those (least sum of the
two error rates).

Null URLs, or without ``://``, have empty host and path and match no rule; null
and empty ones score 0. Repeated rows are judged alike. If either class has no URL to learn from,
every other URL is allowed. Only URLs are shuffled, never pages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepset.llm.arrow import runs, utf8
from keepset.llm.store import stored, table

#: Fixed values of the contract: verdict of each host and path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
ORDER = 6  # a byte and six before it fill 56 bits of a key
BLOCK = 1 << 15        # bytes looked at together
CHUNK_BYTES = 1 << 18
PRIOR = 2.0
BINS = np.linspace(-8.0, 8.0, 3201)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = []
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = text.partition("/")
        fits = ((host_col == at) | host_col.endswith("." + at)) & path_col.startswith("/" + rest)
        found.append(F.when(fits, F.lit(text)))
    return F.coalesce(*found)


def _keys(urls: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of bytes: the URL of each, and a matrix of keys.

    Row k holds the byte with its k predecessors, row ``ORDER`` + 1 + k these
    predecessors alone. A key is those bytes themselves under their row's number, so
    different contexts never meet. A URL starts after ``ORDER`` zero bytes.
    """
    gap = bytes(ORDER)
    flat = np.frombuffer(gap + gap.join(urls), dtype=np.uint8)
    sizes = np.array([len(u) for u in urls], dtype=np.int64)
    starts = ORDER * np.arange(1, len(urls) + 1) + np.append(0, np.cumsum(sizes)[:-1])
    for a in range(ORDER, len(flat), BLOCK):
        at = np.arange(a, min(a + BLOCK, len(flat)))
        owner = np.searchsorted(starts, at, side="right") - 1
        inside = at < starts[owner] + sizes[owner]
        at, owner = at[inside], owner[inside]
        keys = np.empty((2 * (ORDER + 1), len(at)), dtype=np.int64)
        before, last = np.zeros(len(at), dtype=np.int64), flat[at].astype(np.int64)
        for k in range(ORDER + 1):
            if k:
                before |= flat[at - k].astype(np.int64) << 8 * (k - 1)
            keys[k] = k << 56 | before << 8 | last
            keys[ORDER + 1 + k] = ORDER + 1 + k << 56 | before
        yield owner, keys


def scores(urls: list[bytes], keys: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-likelihood difference per byte, accepted minus rejected; 0 for an empty URL.

    ``keys`` are sorted and hold at least those of the URLs that were ever counted.
    """
    out = np.zeros(len(urls))
    if not urls or not len(keys):
        return out
    for owner, wanted in _keys(urls):
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[place] == wanted
        difference = np.zeros(len(owner))
        for counts, sign in ((good, 1.0), (bad, -1.0)):
            n = np.where(known, counts[place], 0)
            p = np.full(len(owner), 1 / 256)
            for k in range(ORDER + 1):
                p = (n[k] + PRIOR * p) / (n[ORDER + 1 + k] + PRIOR)
            difference += sign * np.log(p)
        np.add.at(out, owner, difference)
    return out / np.maximum([len(u) for u in urls], 1)


def gram_counts(rows: DataFrame) -> DataFrame:
    """``key, good, bad``: both models' counts from the rows whose ``accepted`` is known, but one in five.

    The table grows with the URLs and stays distributed; tasks add up their own first.
    """
    learned = rows.where(F.col("accepted").isNotNull() & ~_kept_out()).select("url", "accepted")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, accepted = list(utf8(batch.column("url"))), batch.column("accepted").to_numpy(zero_copy_only=False).astype(bool)
            for owner, keys in _keys(urls) if urls else ():
                found, at = np.unique(keys, return_inverse=True)
                good = np.bincount(at.reshape(-1), np.tile(accepted[owner], len(keys)), len(found)).astype(np.int64)
                n = np.bincount(at.reshape(-1), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(good), pa.array(n - good)], ["key", "good", "bad"])

    counted = learned.mapInArrow(count, "key long, good long, bad long")
    return stored(counted.groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")


def _kept_out() -> Column:
    return F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0


def with_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with ``score``, from their ``url``.

    Rows are dealt to chunks of about ``CHUNK_BYTES`` of URLs, a URL on many rows to
    many of them. A chunk asks the counts for each of its keys once and is scored
    with what comes back, so no task or driver holds the counts.
    """
    total = rows.agg(F.sum(F.coalesce(F.octet_length("url"), F.lit(0)) + 16)).first()[0] or 0
    chunk = F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.lit(1 + total // CHUNK_BYTES))
    placed = stored(rows.withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions("chunk"), "url-chunks")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["chunk"]):
            urls = sorted(set(utf8(group.column("url").combine_chunks())))
            keys = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *(np.unique(keys) for _, keys in _keys(urls))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), group.column("chunk")[0].as_py())), pa.array(keys)], ["chunk", "key"])

    # neither side is broadcast: both grow with the input, and the sizes of their files say little about their rows
    answered = placed.select("chunk", "url").mapInArrow(ask, "chunk long, key long").join(counts.hint("merge"), "key")

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy()
        order = np.argsort(keys)
        held = list(utf8(group.column("url").combine_chunks()))
        urls = sorted(set(held))
        found = dict(zip(urls, scores(urls, keys[order], known.column("good").to_numpy()[order], known.column("bad").to_numpy()[order])))
        return group.drop(["chunk"]).append_column("score", pa.array([found[u] for u in held], pa.float64()))

    schema = StructType([f for f in placed.schema if f.name != "chunk"]).add("score", "double")
    return placed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(score, schema)


def calibrated(scored: DataFrame) -> float:
    """The threshold that best parts the rows with known ``accepted`` that were kept out of the counts."""
    seen = (scored.where(F.col("accepted").isNotNull() & _kept_out()).select("accepted", F.floor(
        (F.least(F.greatest("score", F.lit(-8.0)), F.lit(7.999)) + 8.0) * 200).cast("int").alias("bin"))
        .groupBy("accepted", "bin").count().collect())  # at most two rows per bin
    good, bad = np.zeros(len(BINS)), np.zeros(len(BINS))
    for r in seen:
        (good if r["accepted"] else bad)[r["bin"]] += r["count"]
    if not good.any() or not bad.any():
        return 0.0
    lost = np.append(0, np.cumsum(good)[:-1]) / good.sum()       # accepted URLs below the bin
    passed = 1 - np.append(0, np.cumsum(bad)[:-1]) / bad.sum()   # rejected URLs at or above it
    errors = np.round(lost + passed, 9)
    best = np.flatnonzero(errors == errors.min())
    return float(BINS[best[len(best) // 2]])


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id, host, path, rule, verdict, score`` for each row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    given = F.coalesce(*[F.when(F.col("rule") == text, F.lit(verdict)) for text, verdict in rules])
    rows = rows.withColumn("accepted", given == "allow")
    counts = gram_counts(rows)
    learned = counts.agg(F.max("good").alias("good"), F.max("bad").alias("bad")).first()
    if not learned["good"] or not learned["bad"]:
        own, rows = F.lit("allow"), rows.withColumn("score", F.lit(0.0))
    else:
        rows = stored(with_scores(rows, counts), "url-scores")
        own = F.when(F.col("score") >= calibrated(rows), "allow").otherwise("block")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(given, own).alias("verdict"), "score")


def url_verdicts(spark, sf_dir: str) -> DataFrame:
    """``op9_url_filter``: every page's URL judged."""
    return judged(table(spark, sf_dir, "pages"))
