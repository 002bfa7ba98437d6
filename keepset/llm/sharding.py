"""Extendible hashing into shards of bounded size, with DataFrame functions only.

A document hashes to 60 bits. A shard is a prefix of those bits; it is split on
the next bit only while it is over its byte limit and holds more than one hash.
The directory (prefix, depth, bytes) comes from a histogram of prefixes, summed
at every depth at once; prefixes that are over the limit even at the
histogram's depth go into another round with more bits, alone. Documents meet
the directory in an equi-join on (depth, prefix), one copy per depth in use.

The hash covers id and text, so one id on many rows spreads. Only rows equal in
both share all 60 bits; if such rows exceed the limit they are dealt to numbered
overflow shards, counted per input partition first, so no task gathers them. One
document larger than the limit is a shard of its own.

Null ids and texts count as empty. Repeated rows are kept. An empty table gives
no rows. Only the named columns are read, unless the rows are to be written: then
each travels with its shard as one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepset.llm.store import free_name, stored, table

BITS = 60
LIMIT = 64 << 20
MORE_BITS = 8


def hash_bits(id_col: str, text_col: str):
    """60 bits of md5 over the id and the md5 of the text."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, rows: bool = True) -> DataFrame:
    """``id, n_bytes, shard, depth`` for each row, and the ``row`` itself as a struct unless ``rows`` is off.

    ``shard`` is ``b`` and the prefix bits; overflow shards add ``+`` and a number.
    """
    if limit < 1:
        raise ValueError("a shard needs room for a byte")
    carried = [F.struct("*").alias("row")] if rows else []
    hashed = stored(df.select(F.col(id_col).alias("id"), hash_bits(id_col, text_col).alias("h"),
                              F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), *carried), "shard-rows")
    total = hashed.agg(F.sum("n_bytes")).first()[0] or 0
    depth, found, left = min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + 4), [], hashed
    lowest = 0
    while True:
        directory, over = _directory(left, lowest, depth, limit)
        found.append(_assigned(left, directory))
        if depth == BITS:
            found.append(_overflow(left.join(over.select(F.col("prefix").alias("h")), "h", "left_semi"), limit))
            break
        if over.isEmpty():
            break
        left = stored(left.withColumn("prefix", F.shiftright("h", BITS - depth)).join(over, "prefix", "left_semi").drop("prefix"),
                      "shard-left")
        lowest, depth = depth + 1, min(BITS, depth + MORE_BITS)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.withColumnRenamed("id", id_col)


def _directory(rows: DataFrame, lowest: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards that fit, at depths ``lowest`` to ``depth``; prefixes that do not fit at ``depth``."""
    fine = (rows.groupBy(F.shiftright("h", BITS - depth).alias("fine"))
            .agg(F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("least"), F.max("h").alias("most"), F.count("*").alias("n")))
    every = fine.select("*", F.explode(F.sequence(F.lit(lowest), F.lit(depth))).alias("depth"))
    sums = (every.groupBy("depth", F.expr(f"shiftright(fine, {depth} - depth)").alias("prefix"))
            .agg(F.sum("n_bytes").alias("n_bytes"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")))
    fits = (F.col("n_bytes") <= limit) | ((F.col("least") == F.col("most")) & (F.col("n") == 1))
    sums = stored(sums.withColumn("fits", fits), "shard-directory")
    above = (sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up")))
    leaves = sums.where("fits").withColumn("up", F.shiftright("prefix", 1))
    split = leaves.join(above, ["depth", "up"], "left_semi").select("depth", "prefix")
    top = leaves.where(F.col("depth") == lowest).select("depth", "prefix")
    return split.union(top), sums.where((F.col("depth") == depth) & ~F.col("fits")).select("prefix")


def _assigned(rows: DataFrame, directory: DataFrame) -> DataFrame:
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most 61
    tried = rows.select("*", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>")).alias("depth"))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)"))
    bits = F.expr("concat('b', if(depth = 0, '', lpad(bin(prefix), depth, '0')))")
    return tried.join(directory, ["depth", "prefix"]).select("id", "n_bytes", bits.alias("shard"), "depth", *_carried(rows))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows over the limit: numbered within their input partition, partitions laid end to end."""
    rows = stored(rows.withColumn("part", F.spark_partition_id()), "shard-overflow")
    counts = rows.groupBy("h", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("h", "part").orderBy("n_bytes")) - 1)
    placed = placed.join(counts.withColumn("before", before).drop("n"), ["h", "part"])
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    number = F.floor((F.col("before") + F.col("k")) / room).cast("long")
    return placed.select("id", "n_bytes", F.concat(F.lit("b"), F.lpad(F.bin("h"), BITS, "0"), F.lit("+"), number).alias("shard"),
                         F.lit(BITS).alias("depth"), *_carried(rows))


def _carried(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "row"]


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One folder per shard with its rows of ``df``, as ``shards`` placed each of them; ids may be null or repeat."""
    if "row" not in _carried(placed):
        raise ValueError("the shards were made without their rows")
    name = free_name("shard", df.columns)
    placed.select("row.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)


def document_shards(spark, sf_dir: str) -> DataFrame:
    """``op6_sharding``: every document with its shard of at most 64 MiB."""
    return shards(table(spark, sf_dir, "documents"), rows=False)


def oracle(limit: int = LIMIT) -> str:
    """The same in SQL: the least depth at which the document's prefix fits (no overflow rows)."""
    return f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
p AS (SELECT d.*, CAST(x AS INTEGER) AS depth, h >> CAST({BITS} - x AS BIGINT) AS prefix
  FROM d, unnest(range(0, {BITS + 1})) AS t(x)),
s AS (SELECT depth, prefix, sum(n_bytes) AS total, count(*) AS n FROM p GROUP BY 1, 2),
f AS (SELECT p.doc_id, p.h, p.n_bytes, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix)
  WHERE total <= {limit} OR n = 1 GROUP BY 1, 2, 3)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, depth,
  'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> CAST({BITS} - depth AS BIGINT)), depth, '0') END AS shard
FROM f"""
