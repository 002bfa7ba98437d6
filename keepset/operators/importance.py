"""Importance: popularity times dissimilarity to the rest of the table.

Dissimilarity is 1 - cosine, taken to every row of another id. Cosines of unit
vectors add up like the vectors do, so no pair is ever formed: with S and N the
sum and number of all unit vectors and S_g, n_g those of id g,

* average over the pairs of g:  1 - S_g . (S - S_g) / (n_g (N - n_g))
* sum for one row v of g:       (N - n_g) - v . (S - S_g)

That is one aggregation by id, and one row of totals that reaches the other
expressions as a scalar subquery. A zero vector has cosine 0 with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepset.functions.vectors import dot, dot_columns
from keepset.operators.points import dims_of, feature_points, unit_points
from keepset.operators.popularity import popularity

# An id with more than 1/HOT_SHARE of the rows is joined by broadcast; there
# are fewer than HOT_SHARE such ids whatever the data.
HOT_SHARE = 1000
# Rows of one of the other ids that meet in one task of a shuffled join, about.
ROWS_PER_TASK = 1_000_000


def average_dissimilarity(df: DataFrame, feature_cols: list[str], id_col: str = "Unique_ID", *,
                          on_null: str = "error") -> DataFrame:
    """(id, avg_dissim): mean dissimilarity of the id's rows to all rows of
    other ids. A table with a single id has no such pair and gives no row."""
    units, dims = _unit_rows(df, feature_cols, id_col, [], on_null)
    return _with_average(_by_id(units, dims), dims).select("id", "avg_dissim")


def importance(df: DataFrame, queries: DataFrame | list[dict], feature_cols: list[str],
               id_col: str = "Unique_ID", *, top: int | None = None, on_null: str = "error",
               **popularity_options) -> DataFrame:
    """(id, avg_dissim, pop, importance), most important first, ties by id.

    Both factors are partitioned by id after their sums, so joining them moves
    nothing more, and each side has one row per id whatever the skew.
    """
    far = average_dissimilarity(df, feature_cols, id_col, on_null=on_null)
    scored = far.join(popularity(df, queries, id_col, **popularity_options), "id", "left").fillna(0, ["pop"])
    scored = scored.select("id", "avg_dissim", "pop",
                           (F.col("pop") * F.col("avg_dissim")).alias("importance"))
    scored = scored.orderBy(F.desc("importance"), "id")
    return scored if top is None else scored.limit(top)


def summed_importance(df: DataFrame, pop_col: str = "popularity", id_col: str = "Unique_ID",
                      feature_cols: list[str] | None = None, *, on_null: str = "error",
                      rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, importance, set_importance), one row per input row.

    ``importance`` is the row's popularity, read from ``pop_col``, times the
    sum of its dissimilarities; ``set_importance`` is the mean over all rows,
    the same on each. By default every other column is a feature.
    """
    if feature_cols is None:
        feature_cols = [c for c in df.columns if c not in (id_col, pop_col)]
    weight = F.col(pop_col).cast("double")
    rows, dims = _unit_rows(df, feature_cols, id_col, [pop_col], on_null)
    by_id = _by_id(
        rows, dims, F.sum(weight).alias("weight"),
        *[F.sum(weight * F.col(v)).alias(f"weighted_{v}") for v in dims])
    by_id = _with_rest(by_id, dims)

    # mean of the importances over all rows, from the sums by id alone
    weighted = F.array(*[F.col(f"weighted_{v}") for v in dims])
    of_id = F.col("weight") * (F.col("all_n") - F.col("n")) - dot(weighted, F.col("rest"))
    set_importance = by_id.agg((F.sum(of_id) / F.max("all_n")).alias("mean")).scalar()

    joined = _join_by_id(rows, by_id.select("id", "n", "all_n", "rest"), rows_per_task)
    similar = dot_columns([F.col(v) for v in dims], [F.get("rest", F.lit(i)) for i in range(len(dims))])
    summed = (F.col("all_n") - F.col("n")) - similar
    return joined.select("id", (weight * summed).alias("importance"),
                         set_importance.alias("set_importance"))


def _unit_rows(df: DataFrame, feature_cols: list[str], id_col: str, keep: list[str],
               on_null: str) -> tuple[DataFrame, list[str]]:
    """(id, kept columns, v0 ..) scaled to length 1, and the vector columns."""
    rows = unit_points(feature_points(df, id_col, feature_cols, keep=keep, on_null=on_null))
    return rows, dims_of(rows)


def _by_id(rows: DataFrame, dims: list[str], *more: Column) -> DataFrame:
    return rows.groupBy("id").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"sum_{v}") for v in dims], *more)


def _with_rest(by_id: DataFrame, dims: list[str]) -> DataFrame:
    """The table by id with N as ``all_n`` and, as an array ``rest``, the sum
    of the vectors of all other ids."""
    # every column is summed, so that this reads the same exchange as the rows
    # it is put beside, instead of aggregating the table a second time
    totals = by_id.agg(*[F.sum(c).alias(c) for c in by_id.columns if c != "id"])
    all_v = F.array(*[f"sum_{v}" for v in dims])
    totals = totals.select(F.struct(all_v.alias("v"), *totals.columns).alias("t")).scalar()
    beside = by_id.withColumn("_all", totals)
    own = F.array(*[F.col(f"sum_{v}") for v in dims])
    return beside.select(*by_id.columns, F.col("_all.n").alias("all_n"),
                         F.zip_with("_all.v", own, lambda a, o: a - o).alias("rest"))


def _with_average(by_id: DataFrame, dims: list[str]) -> DataFrame:
    beside = _with_rest(by_id, dims).where("all_n > n")
    pairs = F.col("n").cast("double") * (F.col("all_n") - F.col("n")).cast("double")
    own = F.array(*[F.col(f"sum_{v}") for v in dims])
    return beside.withColumn("avg_dissim", F.lit(1.0) - dot(own, F.col("rest")) / pairs)


def _join_by_id(rows: DataFrame, lookup: DataFrame, rows_per_task: int) -> DataFrame:
    """Rows with their id's line of ``lookup``, hot ids without a shuffle.

    The rows of an id that holds a large share of the table would all meet in
    one task of a shuffled join. Such ids are few by arithmetic, so their lines
    are broadcast and only the other rows are shuffled, see ``_dealt``.
    """
    hot = lookup.where(F.col("n") * HOT_SHARE > F.col("all_n"))
    cold = lookup.where(F.col("n") * HOT_SHARE <= F.col("all_n"))
    dealt, lines = _dealt(rows.join(F.broadcast(hot.select("id")), "id", "left_anti"), cold, rows_per_task)
    return rows.join(F.broadcast(hot), "id").unionByName(dealt.join(lines, ["id", "_part"]).drop("_part"))


def _dealt(rows: DataFrame, lookup: DataFrame, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_part``: an id of more than ``rows_per_task`` rows is
    split into parts of about so many, and its line stands in each of them.

    Fewer than ``all_n / rows_per_task`` ids are split, of which the id and a
    number are broadcast. The part hangs on the place of a row, so equal rows part as well.
    """
    parts = F.ceil(F.col("n") / rows_per_task).cast("int")
    split = lookup.where(F.col("n") > rows_per_task).select("id", parts.alias("_parts"))
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.join(F.broadcast(split), "id", "left").withColumn("_part", F.pmod(place, F.coalesce("_parts", F.lit(1))).cast("int"))
    return dealt.drop("_parts"), lookup.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
