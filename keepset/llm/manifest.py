"""Merkle manifest of a table: built levels as node rows, climbed by a recursive query.

Every row is a leaf, the digest of its columns; per language the leaves in order
of id form a binary tree, and the roots of the languages form one more tree.

1. Rows get their place by a range partitioning on (lang, id, leaf): places are
   the number of rows in earlier partitions plus the place within, so no task
   sees a whole language, and equal rows are dealt apart by a row number.
2. ``STRIDE`` levels at a time are built from at most 2^STRIDE neighbours. What is
   stored is one row per such node: the digests below it level by level, its
   own digest, and the node above with the slot it has there.
3. A recursive query starts at each leaf, joins the node above, appends the
   siblings of that path to the proof, folds the digest through them and goes on at
   the linked parent, until there is none. The digest that is folded may be
   another than the leaf's (a tampered row), so the result verifies or not.

Digests are 32 bytes in the tables and go into each other as lowercase hex text.
Null ids come first in their language, a null language first of all; each null is
``-`` in a leaf. Equal rows are leaves of their own; rows that share an id stand in
the order of their digests. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepset.llm.store import forget, stored, table

STRIDE = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 7
_TOP = -1  # the tree over the languages


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of some values: each ``-`` if null, else its bytes with their count before."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank``, the place of each row in the whole order, and ``part``, a partition it shares with its neighbours."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumn("at", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("part", F.shiftright("at", 33).cast("int"))
    sizes = sorted(tuple(r) for r in ordered.groupBy("part").agg(F.count("*")).collect())  # a row per partition
    before = [(part, sum(n for _, n in sizes[:i])) for i, (part, _) in enumerate(sizes)]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(offsets, "part").withColumn("rank", place).drop("before", "at")


def _climbed(children: str, levels: str) -> str:
    """SQL: ``levels`` + 1 arrays of digests, each made of every two of the last."""
    pair = "concat(lower(hex(x[2 * i])), coalesce(lower(hex(get(x, 2 * i + 1))), ''))"
    above = (f"transform(array(element_at(below, -1)), x -> transform(sequence(0, int((size(x) - 1) div 2)), "
             f"i -> unhex(sha2(cast({pair} as binary), 256))))")
    steps = f"if({levels} = 0, cast(array() as array<int>), sequence(1, {levels}))"
    return f"aggregate({steps}, array({children}), (below, step) -> concat(below, {above}))"


def _trees(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of trees, tier by tier, and ``tree, digest`` of their roots.

    ``nodes``: ``tree, place, digest, height`` of the lowest level, ``height`` the levels of its tree; the tallest has ``height``.
    """
    tiers, roots = [], []
    for tier in range(max(1, -(-height // STRIDE))):
        grouped = (nodes.groupBy("tree", "height", F.shiftright("place", STRIDE).alias("block"))
                   .agg(F.expr("transform(sort_array(collect_list(struct(place, digest))), c -> c.digest)").alias("children")))
        built = grouped.withColumn("all", F.expr(_climbed("children", f"least(height, {STRIDE})")))
        built = stored(built.select("tree", "height", "block", F.lit(tier).alias("tier"),
                                    F.expr("slice(all, 1, size(all) - 1)").alias("levels"), F.expr("element_at(all, -1)[0]").alias("digest")), name)
        tiers.append(built)
        roots.append(built.where(F.col("height") <= STRIDE).select("tree", "digest"))
        nodes = built.where(F.col("height") > STRIDE).select("tree", F.col("block").alias("place"), "digest", (F.col("height") - STRIDE).alias("height"))
    return tiers, reduce(DataFrame.union, roots)


def _linked(tiers: list[DataFrame], above: int | None) -> list[DataFrame]:
    """Node rows with their parent: the next block of their tree, or from a root of ``tree`` on a place of the tree ``above``."""
    mask = (1 << STRIDE) - 1
    linked = []
    for built in tiers:
        last = F.col("height") <= STRIDE
        out = {"up_tree": F.lit(above).cast("long"), "up_tier": F.lit(0), "up_block": F.shiftright("tree", STRIDE), "up_slot": F.col("tree").bitwiseAND(F.lit(mask))}
        inner = {"up_tree": F.col("tree"), "up_tier": F.col("tier") + 1, "up_block": F.shiftright("block", STRIDE), "up_slot": F.col("block").bitwiseAND(F.lit(mask))}
        linked.append(built.select("tree", "tier", "block", "levels", "digest", last.alias("last"),
                                   *[F.when(last, out[n]).otherwise(inner[n]).cast("long").alias(n) for n in out]))
    return linked


def _height(n: Column) -> Column:
    """Levels over ``n`` leaves: bits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


_STEP = """aggregate(n.levels, named_struct('digest', c.folded, 'slot', c.slot, 'proof', c.proof), (a, level) -> named_struct(
  'digest', unhex(sha2(cast(concat(if(a.slot % 2 = 1, lower(hex(get(level, int(a.slot - 1)))), ''), lower(hex(a.digest)),
                                   if(a.slot % 2 = 0, coalesce(lower(hex(get(level, int(a.slot + 1)))), ''), '')) as binary), 256)),
  'slot', shiftright(a.slot, 1),
  'proof', concat(a.proof, coalesce(get(level, int(a.slot ^ 1)), X''))))"""


def _climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """The recursive query: ``id, leaf, folded, proof, subroot, root`` of every leaf."""
    spark, mark = leaves.sparkSession, uuid.uuid4().hex
    starts, above = f"leaves_{mark}", f"nodes_{mark}"
    leaves.createOrReplaceTempView(starts)
    nodes.createOrReplaceTempView(above)
    query = f"""
    WITH RECURSIVE climb(id, leaf, tree, tier, block, slot, folded, proof, subroot, root) AS (
      SELECT id, leaf, tree, 0L, shiftright(place, {STRIDE}), place & {(1 << STRIDE) - 1}L, tampered, X'', CAST(NULL AS BINARY), CAST(NULL AS BINARY)
      FROM {starts}
      UNION ALL
      SELECT id, leaf, up_tree, up_tier, up_block, up_slot, step.digest, step.proof, subroot, root FROM (
        SELECT c.id, c.leaf, n.up_tree, n.up_tier, n.up_block, n.up_slot, {_STEP} AS step,
               coalesce(c.subroot, if(n.last, n.digest, NULL)) AS subroot, if(n.last AND n.up_tree IS NULL, n.digest, NULL) AS root
        FROM climb c JOIN {above} n ON c.tree = n.tree AND c.tier = n.tier AND c.block = n.block)
    )
    SELECT id, leaf, folded, proof, subroot, root FROM climb WHERE root IS NOT NULL LIMIT ALL"""  # every leaf climbs: no limit on rows
    try:
        return spark.sql(query)
    finally:
        spark.catalog.dropTempView(starts)
        spark.catalog.dropTempView(above)


def manifest(df: DataFrame, leaf_of: Column, tampered: Column, id_col: str = "doc_id", tree_col: str = "lang") -> DataFrame:
    """``id, leaf, subroot, root, proof, folded`` per row of ``df``; all but the id are digests as lowercase hex.

    ``proof`` holds the siblings from the leaf up to the root one after the other. ``folded``
    is the root recomputed from ``tampered`` and that proof: equal to ``root`` where it is the leaf.
    """
    source = stored(df.select(F.col(id_col).alias("id"), F.col(tree_col).cast("string").alias("name"), leaf_of.alias("leaf"),
                              tampered.alias("tampered"), F.monotonically_increasing_id().alias("row")), "manifest-leaves")
    order = [F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    leaves = _ranked(source, order, "manifest-ordered")
    spans = leaves.groupBy("part", "name").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    trees = spans.groupBy("name").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    trees = _ranked(trees, [F.col("name").asc_nulls_first()], "manifest-trees").select(F.col("name").alias("tree_name"), "first", "n", F.col("rank").alias("tree"))
    # a language meets its number once per partition, not once per row
    known = spans.select("part", "name").join(trees, F.col("name").eqNullSafe(F.col("tree_name"))).withColumnRenamed("part", "in_part").drop("name")
    placed = (leaves.join(known, F.col("name").eqNullSafe(F.col("tree_name")) & (F.col("part") == F.col("in_part")))
              .select("id", "leaf", "tampered", "tree", (F.col("rank") - F.col("first")).alias("place"), _height(F.col("n")).alias("height")))
    placed = stored(placed, "manifest-placed")
    forget(source, leaves)

    n_trees, tallest = trees.agg(F.count("*"), F.max(_height(F.col("n")))).first()
    tiers, roots = _trees(placed.select("tree", "place", F.col("leaf").alias("digest"), "height"), tallest or 0, "manifest-nodes")
    over = max(n_trees - 1, 0).bit_length()
    tops, _ = _trees(roots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(over).alias("height")), over, "manifest-top")
    nodes = reduce(DataFrame.union, [*_linked(tiers, _TOP), *_linked(tops, None)])
    climbed = _climb(placed.select("id", "leaf", "tampered", "tree", "place"), nodes)
    return climbed.select("id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof", "folded")])


def tampered_rows(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of ``TAMPER_MODULUS``; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPER_MODULUS == 0, F.lit(False))


def document_manifest(spark, sf_dir: str) -> DataFrame:
    """``op11_manifest``: every document as a leaf, its proof, and whether the perhaps tampered row still verifies."""
    docs = table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in COLUMNS}
    changed = {**columns, "n_chars": F.when(tampered_rows(), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = manifest(docs, leaf(columns), leaf(changed))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def oracle() -> str:
    """``op11_manifest`` in SQL: levels by a recursive grouping, proofs by looking up the sibling of every ancestor."""
    def digest(n_chars: str) -> str:
        parts = [f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(parts)})"

    eight = "list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"  # fixed value: the polynomial of crc32
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, code: {eight}), 4294967295::BIGINT)"
    level = """SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM {t} WHERE n > 1
               GROUP BY tree, level, place // 2, n"""
    return f"""
    WITH RECURSIVE marked AS (
      SELECT *, coalesce({crc} % {TAMPER_MODULUS} = 0, FALSE) AS hit FROM documents),
    leaves AS (
      SELECT doc_id, lang, {digest('n_chars')} AS leaf, {digest('CASE WHEN hit THEN n_chars + 1 ELSE n_chars END')} AS tampered,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             count(*) OVER (PARTITION BY lang) AS n
      FROM marked),
    low(tree, level, place, digest, n) AS (
      SELECT tree, 0::BIGINT, place, leaf, n FROM leaves UNION ALL {level.format(t='low')}),
    subroots AS (SELECT tree, max(level) AS levels, arg_max(digest, level) AS subroot FROM low GROUP BY tree),
    top(tree, level, place, digest, n) AS (
      SELECT 0::BIGINT, 0::BIGINT, tree, subroot, (SELECT count(*) FROM subroots) FROM subroots UNION ALL {level.format(t='top')}),
    ends AS (SELECT max(level) AS levels, arg_max(digest, level) AS root FROM top),
    climb(place, tree, step, lows, subroot, digest, proof) AS (
      SELECT place, l.tree, 0::BIGINT, s.levels, subroot, tampered, '' FROM leaves l JOIN subroots s USING (tree)
      UNION ALL
      SELECT c.place, c.tree, c.step + 1, c.lows, c.subroot,
             CASE WHEN b.digest IS NULL THEN sha256(c.digest) WHEN c.at % 2 = 1 THEN sha256(b.digest || c.digest) ELSE sha256(c.digest || b.digest) END,
             c.proof || coalesce(b.digest, '')
      FROM (SELECT *, CASE WHEN step < lows THEN place >> step ELSE tree >> (step - lows) END AS at FROM climb) c CROSS JOIN ends
      LEFT JOIN (SELECT tree, level, place, digest FROM low UNION ALL SELECT -1, level, place, digest FROM top) b
        ON b.tree = CASE WHEN c.step < c.lows THEN c.tree ELSE -1 END AND b.level = CASE WHEN c.step < c.lows THEN c.step ELSE c.step - c.lows END
           AND b.place = xor(c.at, 1)
      WHERE c.step < c.lows + ends.levels)
    SELECT doc_id, leaf, c.subroot, root, sha256(proof) AS proof_sha256, c.digest AS folded_root, c.digest = root AS verified
    FROM leaves l JOIN climb c USING (tree, place) CROSS JOIN ends WHERE c.step = c.lows + ends.levels"""
