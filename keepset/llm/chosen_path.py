"""Near duplicates by a chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets are folded first. Each set then carries ``TOKENS``
minwise tokens. In each of ``TREES`` independent trees a document starts on
``ROOT_BRANCHES`` branches, one per selected token; documents that share the token
are a node. A node of up to ``NODE`` documents is compared exhaustively. A larger
one is branched again: every document goes on along two tokens chosen by the
node's path. Branching stops where it no longer separates (the documents share
most tokens) or at ``DEPTH``; what is still large is compared in pairs of blocks.

Two sets with similarity 0.8 share a chosen token with probability 0.8 and lose
both branches of a node for good with 0.0625, so nine roots miss them with
probability 0.25**9, under 4e-6; closer sets are missed less.

Comparison has two steps. Within a node, documents keep their place only next to
one that shares enough tokens (13 of 32, which a true pair misses with 1e-6), and
a pair counts in one node only, the first that holds both. For the kept places the
full shingle sets are computed and all intersections of a node found by one
matrix product. A node passes on links that span its linked documents, not all
pairs; components of these are the components of all links, as no pair of a
node goes unexamined.

A copy group of any size is one vertex, a large group of near copies is dealt in
block pairs over tasks. Documents without words stay alone. Null ids are not
linked and kept. Rows with one id are one document: a link of either text counts.
Null texts count as empty. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.llm import bloom
from keepset.llm.arrow import lists, released, runs, utf8
from keepset.llm.components import components
from keepset.llm.shingles import minwise, set_key, shingle_set
from keepset.llm.store import stored, table

TREES, ROOT_BRANCHES, BRANCHES = 3, 3, 2
TOKENS = 32
AGREE = 13
NODE = 512
DEPTH = 4
DENSE = 0.5
_ROOTS = TREES * ROOT_BRANCHES
_BASE = "doc_id long, n_shingles long, k1 long, k2 long, tokens array<int>"


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, k1, k2, tokens`` of each row."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, keys, tokens = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, TOKENS), np.int32)
            for i, text in enumerate(utf8(batch.column("text"))):
                found = shingle_set(text, size)
                sizes[i], keys[i] = len(found), set_key(found)
                if len(found):
                    tokens[i] = minwise(found, TOKENS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                                              lists(tokens)], ["doc_id", "n_shingles", "k1", "k2", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(work), _BASE)


def _nodes(reps: DataFrame) -> DataFrame:
    """Places to compare: ``node, root, block, id``; ``root`` is the root branch of an undivided node, else -1."""
    roots = [F.struct(F.lit(i).alias("root"), F.xxhash64(F.lit(i), F.element_at("tokens", i + 1)).alias("node")) for i in range(_ROOTS)]
    places = reps.select("id", F.explode(F.array(*roots)).alias("at")).select("at.node", "at.root", "id")
    leaves = None
    for level in range(DEPTH + 1):
        sizes = places.groupBy("node").agg(F.count("*").alias("g")).where("g > 1")
        placed = stored(places.join(sizes, "node"), f"nodes-{level}")
        large = placed.where(F.col("g") > NODE)
        done = placed.where(F.col("g") <= NODE)
        leaves = done if leaves is None else leaves.union(done)
        if level == DEPTH:
            leaves = leaves.union(large)
            break
        if large.isEmpty():
            break
        token = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS - _ROOTS)).cast("int") + _ROOTS + 1 for j in range(BRANCHES)]
        below = [F.xxhash64("node", t, F.element_at("tokens", t)) for t in token]
        grown = stored(large.join(reps.select("id", "tokens"), "id")
                       .select("node", "root", "g", "id", F.explode(F.array(*below)).alias("child")), f"grown-{level}")
        shared = grown.groupBy("node", "g", "child").agg(F.count("*").alias("c"))
        dense = (shared.groupBy("node").agg((F.sum(F.col("c").cast("double") * F.col("c")) / BRANCHES / F.first("g") / F.first("g")).alias("s"))
                 .where(F.col("s") >= DENSE).select("node"))
        leaves = leaves.union(large.join(dense, "node", "left_semi"))
        places = grown.join(dense, "node", "left_anti").select(F.col("child").alias("node"), F.lit(-1).alias("root"), "id").distinct()
    blocks = F.ceil(F.col("g") / NODE).cast("int")
    return leaves.select("node", "root", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that its block is part of: ``a <= b``."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("other"))
    return rows.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "blocks")


def _promising(group: pa.Table) -> np.ndarray:
    """Rows of a node that have a likely partner whose pair this node owns."""
    tokens = np.stack(group.column("tokens").to_numpy())
    sizes, block = group.column("n").to_numpy(), group.column("block").to_numpy()
    n, root = len(sizes), group.column("root")[0].as_py()
    agree = np.zeros((n, n), dtype=np.uint8)
    owned = np.ones((n, n), dtype=bool)
    in_leaf = group.column("in_leaf").to_numpy()
    for i in range(TOKENS):
        same = tokens[:, None, i] == tokens[None, :, i]
        agree += same
        if i < _ROOTS and (root < 0 or i < root):
            leaf = (in_leaf >> i & 1).astype(bool)
            owned &= ~(same & leaf[:, None] & leaf[None, :])
    likely = (agree >= AGREE) & owned
    likely &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= 80 * np.maximum(sizes[:, None], sizes[None, :])
    if group.column("a")[0].as_py() != group.column("b")[0].as_py():
        likely &= block[:, None] != block[None, :]
    np.fill_diagonal(likely, False)
    return likely.any(axis=1)


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first set of its linked group: 100 * common >= 80 * union, exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = np.array([[sizes[0], 0], [0, sizes[1]]], dtype=np.float64)
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        flat = np.concatenate(sets)
        _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
        row, repeated = np.repeat(np.arange(n), sizes), seen[column] > 1
        row, column = row[repeated], np.cumsum(seen > 1)[column[repeated]] - 1
        common, width = np.zeros((n, n), dtype=np.float64), 2048
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        last = int(column[-1]) + 1 if len(column) else 0
        for a in range(0, last, width):
            lo, hi = np.searchsorted(column, (a, a + width))
            part = np.zeros((n, width), dtype=np.float32)
            part[row[lo:hi], column[lo:hi] - a] = 1
            common += part @ part.T
    near = 100 * common >= 80 * (sizes[:, None] + sizes[None, :] - common)
    first = np.full(n, -1)
    for i in range(n):
        if first[i] < 0:
            first[i] = i
            front = [i]
            while front:
                new = np.flatnonzero(near[front].any(axis=0) & (first < 0))
                first[new] = i
                front = new.tolist()
    return first


def near_links(docs: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """``u, v``: links between representatives that span all linked pairs. ``base`` is ``sketched(docs)`` with ``rep``."""
    reps = stored(base.where("doc_id = rep AND n_shingles > 0").groupBy(F.col("doc_id").alias("id"), "k1")
                  .agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens")), "reps")
    nodes = stored(_nodes(reps), "places")
    in_leaf = (nodes.where("root >= 0").groupBy("id").agg(F.expr("bit_or(shiftleft(1, root))").alias("in_leaf")))
    known = reps.join(in_leaf, "id", "left").select("id", "k1", "n", "tokens", F.coalesce("in_leaf", F.lit(0)).alias("in_leaf"))
    rows = _in_pairs(nodes.join(known, "id")).repartition("node", "a", "b").sortWithinPartitions("node", "a", "b")

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["node", "a", "b"]):
            if group.num_rows > 1:
                found = group.filter(pa.array(_promising(group)))
                if found.num_rows:
                    yield from found.select(["node", "a", "b", "id", "k1"]).to_batches()

    places = stored(rows.mapInArrow(kept, "node long, a int, b int, id long, k1 long"), "kept-places")
    wanted = places.groupBy("id", "k1").agg(F.collect_list(F.struct("node", "a", "b")).alias("at"))
    words = bloom.build(wanted.select(F.xxhash64("id").alias("h")), "h")

    def maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.contains(words, batch.column("h").to_numpy(zero_copy_only=False)))).select(["id", "text"])

    some = (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
            .withColumn("h", F.xxhash64("id")).mapInArrow(maybe, "id long, text string"))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at = (batch.column(c).to_pylist() for c in ("id", "k1", "at"))
            for i, text in enumerate(utf8(batch.column("text"))):
                found = shingle_set(text, size)
                if set_key(found)[0] != keys[i]:
                    continue  # another text under the same id
                blob, n = found.tobytes(), len(at[i])
                yield pa.RecordBatch.from_arrays([pa.array([p["node"] for p in at[i]], pa.int64()), pa.array([p["a"] for p in at[i]], pa.int32()),
                                                  pa.array([p["b"] for p in at[i]], pa.int32()), pa.array([ids[i]] * n, pa.int64()),
                                                  pa.array([blob] * n, pa.binary())], ["node", "a", "b", "id", "set"])

    full = (some.join(wanted, "id").mapInArrow(released(placed), "node long, a int, b int, id long, set binary")
            .repartition("node", "a", "b").sortWithinPartitions("node", "a", "b"))

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["node", "a", "b"]):
            ids = group.column("id").to_numpy()
            if len(ids) < 2:
                continue
            first = _linked([np.frombuffer(b, dtype=np.uint64) for b in group.column("set").to_pylist()])
            moved = np.flatnonzero(first != np.arange(len(ids)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[first[moved]])], ["u", "v"])

    return full.mapInArrow(released(compared), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; shingles of ``size`` words, similarity 0.8 or more."""
    base = stored(sketched(docs, size), "sketches")
    linkable = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    based = base.join(classes, ["k1", "k2"], "left").withColumn(
        "rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    based = stored(based, "folded")
    several = (based.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("most")).where("u <> most").select("doc_id", "u"))
    same_id = based.join(several, "doc_id").select("u", F.col("rep").alias("v"))  # one id, several texts
    found = components(near_links(docs, based, size).union(same_id))
    rows = based.select("doc_id", "n_shingles", "rep").join(found, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicate_documents(spark, sf_dir: str) -> DataFrame:
    """``op8_near_duplicates``: shingles of four words, as its contract says."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def keep_first(docs: DataFrame) -> DataFrame:
    """The document of smallest id of each group, all columns kept; shingles of five words."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
