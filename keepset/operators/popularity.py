"""Popularity: how many workload queries select each row.

The workload is a table, and matching it is one join: each base row is laid out
as one key per condition column, the keys are looked up in the broadcast
workload, and what is found is added up by id. The base table is not shuffled
for that, so a constant held by a third of its rows is no heavier than another,
and only sums by id leave a partition.

A query with several AND conditions is looked up by its *anchor*, the
condition fewest base rows meet; its other conditions are part of the join
condition and are checked before a joined row exists. An OR query is looked up
by each of its conditions and counted at the first one that holds.

What is broadcast is the workload, and it is measured first. A line of it has
room for the conditions of the longest query, so it counts as that many. Beyond
``MAX_BROADCAST_CONDITIONS`` in all, nothing is broadcast but the hot keys: keys and
lookup are both shuffled, in one pass over the base rows whatever the number of queries. A
key held by more than 1/``PARTS`` of all cells is split: its lines are repeated
under as many numbers as it takes, and each cell has one of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepset.functions.guards import required
from keepset.operators.columns import INTEGRAL
from keepset.operators.workload import workload_from_dicts
from keepset.session import materialize

# About 100 bytes per condition: 20 MB at most in one broadcast.
MAX_BROADCAST_CONDITIONS = 200_000
# A key with more than this share of all cells is split, so fewer keys than this are hot.
PARTS = 1000
# Up to here a sum of CASE terms is faster than a join; for queries of one condition, so many a column.
MAX_CASE_CONDITIONS = 64
CASES_PER_COLUMN = 16
EMPTY_QUERY = ("none", "all")


def popularity(df: DataFrame, queries: DataFrame | list[dict], id_col: str = "Unique_ID",
               **options) -> DataFrame:
    """(id, pop): per id, how many queries select its rows, summed over them.

    ``null_safe``: a null constant selects the rows that hold a null there;
    otherwise it selects nothing. ``empty_query``: whether a query without
    conditions selects ``"none"`` or ``"all"`` of the rows.
    """
    found = popularity_parts(df, queries, [id_col], **options)
    by_id = found.groupBy(required(found, id_col).alias("id"))
    return by_id.agg(F.sum("pop").alias("pop"))


def row_popularity(df: DataFrame, queries: DataFrame | list[dict], id_col: str = "Unique_ID",
                   **options) -> DataFrame:
    """(id, pop) with one row per input row.

    A workload small enough for CASE terms is a projection. Otherwise the parts
    of a row are added up by its number; these are written out first where
    the parts come from two readings of the rows."""
    found, whole = _parts(df, queries, [id_col], numbered=True, **options)
    if whole:
        return found.select(required(found, id_col).alias("id"), "pop")
    by_row = found.groupBy("_row_no", required(found, id_col).alias("id"))
    return by_row.agg(F.sum("pop").alias("pop")).select("id", "pop")


def popularity_in_batches(df: DataFrame, batches: list[DataFrame] | list[list[dict]],
                          id_col: str = "Unique_ID", **options) -> DataFrame:
    """Popularity of several workloads together, most popular first."""
    return ranked(merge_by_union([popularity(df, b, id_col, **options) for b in batches]))


def merge_by_union(parts: list[DataFrame]) -> DataFrame:
    """Popularities of separate workloads added up by id."""
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("pop").alias("pop"))


def merge_by_join(parts: list[DataFrame]) -> DataFrame:
    """The same by outer joins; an id missing from one side counts 0 there."""
    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("pop", "more"), "id", "full_outer")
        zero = F.lit(0).cast("long")
        return both.select("id", (F.coalesce("pop", zero) + F.coalesce("more", zero)).alias("pop"))
    return reduce(add, parts)


def ranked(pop: DataFrame) -> DataFrame:
    """Most popular first, ties by id."""
    return pop.orderBy(F.desc("pop"), "id")


# -- matching --------------------------------------------------------------

@dataclass(frozen=True)
class _Layout:
    """How a base row is laid out as keys: place i holds condition column i.

    A key is the value with the place in its low bits. Constants too large for
    that (``wide``) make the keys (place, value) pairs instead.
    """
    names: list[str]
    reals: list[bool]
    integral: list[bool]
    null_safe: bool
    wide: bool

    @property
    def bits(self) -> int:
        return len(self.names).bit_length()

    @property
    def limit(self) -> int:
        return largest_constant(len(self.names))

    @property
    def always(self) -> Column:
        """A key every row has, so that no row is lost in the join."""
        place = F.lit(len(self.names))
        return F.struct(place.alias("place"), F.lit(0).cast("long").alias("x")) if self.wide \
            else place.cast("long")

    def place(self, key: str) -> Column:
        return F.col(f"{key}.place") if self.wide else F.col(key).bitwiseAND(F.lit(2 ** self.bits - 1)).cast("int")

    def key(self, place: Column, x: Column) -> Column:
        """The key of a long; null for null unless nulls are to match."""
        if self.wide:
            pair = F.struct(place.cast("int").alias("place"), x.alias("x"))
            return pair if self.null_safe else F.when(x.isNotNull(), pair)
        packed = F.shiftleft(x, self.bits).bitwiseOR(place.cast("long"))
        if self.null_safe:
            null = F.shiftleft(F.lit(self.limit + 1).cast("long"), self.bits).bitwiseOR(place.cast("long"))
            return F.coalesce(packed, null)
        return packed

    def cells(self, df: DataFrame) -> Column:
        """All keys of a base row, in place order, the common one last."""
        keys = []
        for i, (name, integral) in enumerate(zip(self.names, self.integral)):
            kind, x = df.schema[name].dataType, F.col(name)
            if integral:
                value = x.cast("long")
                in_range = value.between(-self.limit, self.limit)
                safe = self.wide or not isinstance(kind, T.LongType)
            else:
                # no constant equals a fraction, a NaN or an infinity; decimals are tested as decimals
                exact = x if isinstance(kind, T.DecimalType) else x.cast("double")
                value = exact.try_cast("long")
                in_range = (exact == F.floor(exact)) & value.between(-self.limit, self.limit)
                safe = False
            key = self.key(F.lit(i), value)
            if not safe:
                # out of range is not null: it matches nothing, null-safe or not
                key = F.when(x.isNull() | in_range, key) if self.null_safe else F.when(in_range, key)
            keys.append(key)
        return F.array(*keys, self.always)


def largest_constant(n_columns: int) -> int:
    """Largest constant a packed key can hold beside the place bits."""
    return 2 ** (63 - n_columns.bit_length()) - 2


def popularity_parts(df: DataFrame, queries: DataFrame | list[dict], keep: list[str], **options) -> DataFrame:
    """(keep .., pop): every base row at least once, with parts of its
    popularity; summing ``pop`` by the kept columns gives the whole."""
    return _parts(df, queries, keep, **options)[0]


def _parts(df: DataFrame, queries: DataFrame | list[dict], keep: list[str], *,
           null_safe: bool = False, empty_query: str = "none",
           max_case: int = MAX_CASE_CONDITIONS, max_broadcast: int = MAX_BROADCAST_CONDITIONS,
           numbered: bool = False) -> tuple[DataFrame, bool]:
    """The parts, and whether each base row stands once, with its whole
    popularity. ``numbered`` adds ``_row_no`` where rows stand several times."""
    if empty_query not in EMPTY_QUERY:
        raise ValueError(f"empty_query must be one of {EMPTY_QUERY}, not {empty_query!r}")
    if isinstance(queries, list):
        workload = workload_from_dicts(df.sparkSession, queries)
    else:
        workload = materialize(queries)

    seen = workload.groupBy("col").agg(
        F.count("*").alias("n"), F.max("n_conds").alias("n_conds"),
        F.max(F.col("val").isNull()).alias("has_null"), F.min("val").alias("low"), F.max("val").alias("high"),
        F.max((F.col("connector") == "AND") & (F.col("n_conds") > 1)).alias("has_and"),
    ).collect()  # one row per column
    n_empty = sum(r["n"] for r in seen if r["col"] is None)
    at_start = n_empty if empty_query == "all" else 0
    seen = sorted((r for r in seen if r["col"] is not None), key=lambda r: r["col"])
    kinds = {r["col"]: df.schema[r["col"]].dataType for r in seen}
    for name, kind in kinds.items():
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"condition column {name!r} is {kind.simpleString()}, not numeric")
    # a constant meets a double or float column as a double, in either form
    reals = {name for name, kind in kinds.items() if isinstance(kind, (T.DoubleType, T.FloatType))}
    total = sum(r["n"] for r in seen)
    shape = _Shape(longest=max((r["n_conds"] for r in seen), default=0), has_and=any(r["has_and"] for r in seen),
                   has_null=any(r["has_null"] for r in seen))
    single = max_case and shape.longest == 1 and total <= CASES_PER_COLUMN * len(seen)
    if total <= max_case or single:
        start = F.lit(at_start).cast("long")
        return df.select(*keep, (start + _case_sum(workload, null_safe, reals) if total else start).alias("pop")), True

    # half of it, as a constant for a double column may be rounded up
    bound = largest_constant(len(seen)) // 2
    layout = _Layout(
        names=list(kinds), reals=[name in reals for name in kinds], integral=[isinstance(k, INTEGRAL) for k in kinds.values()], null_safe=null_safe,
        wide=any(max(abs(r["low"] or 0), abs(r["high"] or 0)) > bound for r in seen))
    fits = _lines(workload) * shape.longest <= max_broadcast
    if numbered:
        df, keep = df.withColumn("_row_no", F.monotonically_increasing_id()), ["_row_no", *keep]
        df = df if fits else materialize(df)
    if fits:
        always = df.sparkSession.range(1).select(layout.always.alias("key"), F.lit(at_start).cast("long").alias("times"))
        lookup = materialize(_lookup(workload, layout, df, shape).unionByName(always, allowMissingColumns=True))
        return _matches(df, lookup, layout, keep), False
    heat = materialize(_heat(df, layout))
    lookup = materialize(_lookup(workload, layout, df, shape, heat))
    found = _shuffled_matches(df, lookup, layout, keep, heat)
    return df.select(*keep, F.lit(at_start).cast("long").alias("pop")).unionByName(found), False


def _lines(workload: DataFrame) -> int:
    """Lines of the lookup: one for an AND query, one for each condition of an OR query."""
    lines = F.when(F.col("connector") == "AND", 1 / F.col("n_conds")).otherwise(F.lit(1.0))
    return round(workload.where("n_conds > 0").agg(F.sum(lines)).first()[0] or 0)


@dataclass(frozen=True)
class _Shape:
    longest: int     # conditions of the longest query
    has_and: bool    # some AND query has more than one
    has_null: bool   # some constant is null


def _case_sum(workload: DataFrame, null_safe: bool, reals: set[str]) -> Column:
    """A handful of queries as one flat sum of CASE terms: no lookup to build
    and no join. The size of the workload is checked by the caller."""
    by_query: dict = {}
    for r in workload.where("n_conds > 0").collect():
        by_query.setdefault((r["query_id"], r["connector"]), []).append((r["col"], r["val"]))
    terms = []
    for (_, connector), conds in by_query.items():
        held = []
        for c, v in conds:
            x, constant = (F.col(c).cast("double"), F.lit(v).cast("double")) if c in reals else (F.col(c), F.lit(v))
            held.append(x.eqNullSafe(constant) if null_safe else x == constant)
        joined = reduce((lambda a, b: a & b) if connector == "AND" else (lambda a, b: a | b), held)
        terms.append(F.when(joined, 1).otherwise(0).cast("long"))
    return reduce(lambda a, b: a + b, terms)


def _matches(df: DataFrame, lookup: DataFrame, layout: _Layout, keep: list[str]) -> DataFrame:
    """The lookup joined to the base rows: one broadcast join for all queries,
    the remaining conditions of a query checked inside it. A row is looked up
    by the columns that queries are anchored at, not by all of them."""
    anchors = sorted(r["place"] for r in lookup.select(layout.place("key").alias("place")).distinct().collect())
    laid_out = df.select(*keep, layout.cells(df).alias("_row"))
    looked_up = F.array(*[F.get("_row", F.lit(i)) for i in anchors])
    cells = laid_out.select("*", F.explode_outer(looked_up).alias("_key"))
    return cells.join(F.broadcast(lookup), _holds(lookup)).select(*keep, F.col("times").alias("pop"))


def _heat(df: DataFrame, layout: _Layout) -> DataFrame:
    """(key, freq): how many base rows have each key, counted on each partition first."""
    keys = F.slice(layout.cells(df), 1, len(layout.names))
    return df.select(F.explode(keys).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("freq"))


def _split(heat: DataFrame) -> DataFrame:
    """(hot, parts): the keys with more than 1/``PARTS`` of all cells and in how many each is split; fewer than ``PARTS`` rows."""
    most = max((heat.agg(F.sum("freq")).first()[0] or 0) // PARTS, 1)
    hot = heat.where(F.col("freq") > most).select(F.col("key").alias("hot"), F.ceil(F.col("freq") / most).cast("int").alias("parts"))
    return F.broadcast(materialize(hot))


def _dealt_cells(cells: DataFrame, split: DataFrame, keep: list[str]) -> DataFrame:
    """The cells, each with the part of its key: equal rows go by the partition they are read in, which a lost task reads again."""
    part = F.pmod(F.xxhash64(F.spark_partition_id(), *keep), F.col("parts")).cast("int")
    return cells.join(split, F.col("_key") == F.col("hot"), "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("hot", "parts")


def _shuffled_matches(df: DataFrame, lookup: DataFrame, layout: _Layout, keep: list[str], heat: DataFrame) -> DataFrame:
    """The lookup joined to the base rows by a shuffle of both, hot keys split."""
    anchors = sorted(r["place"] for r in lookup.select(layout.place("key").alias("place")).distinct().collect())
    if not anchors:  # no query can hold
        return df.where("false").select(*keep, F.lit(0).cast("long").alias("pop"))
    split = _split(heat)
    laid_out = df.select(*keep, layout.cells(df).alias("_row"))
    looked_up = F.array(*[F.get("_row", F.lit(i)) for i in anchors])
    cells = laid_out.select(*keep, *(["_row"] if "rest" in lookup.columns else []), F.explode(looked_up).alias("_key")).where("_key IS NOT NULL")
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    lines = lookup.join(split, F.col("key") == F.col("hot"), "left").withColumn("part", F.explode(parts)).drop("hot", "parts")
    on = _holds(lookup) & (F.col("_part") == F.col("part"))
    return _dealt_cells(cells, split, keep).join(lines.hint("shuffle_merge"), on).select(*keep, F.col("times").alias("pop"))


def _holds(lookup: DataFrame) -> Column:
    """Whether a cell meets a line of the lookup: its key, and the remaining conditions in the row."""
    on = F.col("_key") == F.col("key")
    if "rest" in lookup.columns:
        return on & F.forall("rest", lambda c: F.get("_row", c["place"]).eqNullSafe(c["key"]) == F.col("want"))
    for c in lookup.columns:
        if c.startswith("place"):
            same = F.get("_row", F.col(c)).eqNullSafe(F.col(c.replace("place", "key")))
            on = on & (F.col(c).isNull() | (same == F.col("want")))
    return on


def _lookup(workload: DataFrame, layout: _Layout, base: DataFrame, shape: _Shape, heat: DataFrame | None = None) -> DataFrame:
    """(key, times, want, place1, key1, ..): a base row that has ``key`` gains
    ``times``, provided that each further key is (``want``) or is not in its
    place. Equal queries are folded into one line. With ``heat``, the frequencies of
    all keys, the further ones are one array ``rest``."""
    places = F.create_map(*[x for i, name in enumerate(layout.names) for x in (F.lit(name), F.lit(i))])
    conds = workload.where("n_conds > 0").withColumn("place", places[F.col("col")])
    if shape.has_null and not layout.null_safe:
        # a null constant never holds: its AND query is dead, its OR term drops out
        known = conds.groupBy("query_id").agg(F.min(F.col("val").isNotNull()).alias("known"))
        conds = (conds.join(known, "query_id").where(F.col("known") | (F.col("connector") == "OR"))
                 .where(F.col("val").isNotNull()))
    reals = [i for i, real in enumerate(layout.reals) if real]
    constant = F.when(F.col("place").isin(reals), F.col("val").cast("double").try_cast("long")).otherwise(F.col("val"))
    conds = conds.select("query_id", "connector", "cond_no", "place",
                         layout.key(F.col("place"), constant).alias("key"))
    times = F.count("*").alias("times")
    if shape.longest == 1:
        return conds.groupBy("key").agg(times)

    if shape.has_and:
        conds = conds.join(F.broadcast(_frequencies(base, conds, layout)) if heat is None else heat, "key", "left")
    else:
        conds = conds.withColumn("freq", F.lit(0).cast("long"))
    per_query = conds.groupBy("query_id", "connector").agg(
        F.sort_array(F.collect_list(F.struct(
            F.coalesce("freq", F.lit(0)).alias("freq"), "cond_no", "place", "key"))).alias("conds"))

    # an AND query goes to its rarest condition, the others must hold; an OR
    # query goes to every condition, no earlier one may hold
    is_and = F.col("connector") == "AND"
    last = F.when(is_and, F.lit(0)).otherwise(F.size("conds") - 1)
    anchored = per_query.select(is_and.alias("want"), "conds", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    rest = F.when(F.col("want"), F.slice("conds", F.lit(2), F.size("conds"))).otherwise(
        F.slice("conds", F.lit(1), F.col("at")))
    # in place order, so that equal queries come out as equal lines
    rest = F.array_sort(F.transform(rest, lambda c: F.struct(c["place"].alias("place"), c["key"].alias("key"))))
    folded = (anchored.select(F.get("conds", F.col("at"))["key"].alias("key"), "want", rest.alias("rest"))
              .groupBy("key", "want", "rest").agg(times))
    if heat is not None:  # shuffled lines are as long as their own query
        return folded.select("key", "times", "want", "rest")
    further = [F.get("rest", F.lit(j))[part].alias(f"{part}{j + 1}")
               for j in range(shape.longest - 1) for part in ("place", "key")]
    return folded.select("key", "times", "want", *further)


def _frequencies(base: DataFrame, conds: DataFrame, layout: _Layout) -> DataFrame:
    """(key, freq): how many base rows have each key of the workload. Only
    those keys leave the join, and they are counted on each partition first."""
    keys = conds.select("key").distinct()
    cells = base.select(F.explode_outer(layout.cells(base)).alias("key"))
    return cells.join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("freq"))
