"""Bounded samples of labelled rows, the same however the table is laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 16


def held_out(folds: int, fold: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text falls on ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents.

    Rows of ``labels`` with a null id or label are left out, a repeated id
    counts once (its largest label). The ids are taken in the order of a hash,
    so at most ``rows`` of them are broadcast. Of an id that ``docs`` holds several
    times, the text with the smallest hash is taken, so the sample stays bounded.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).where(keep)
             .groupBy("doc_id").agg(F.max((F.col(label_col) > 0).cast("int")).alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), "text").alias("t")).join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id", "label").agg(F.min("t").alias("t")).select("doc_id", "t.text", "label")
    return once.repartition(PARTS)  # so small a shuffle would be read by one task
