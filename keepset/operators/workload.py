"""Workloads: tables of equality queries.

A workload has one row per condition: ``(query_id, connector, cond_no, col,
val, n_conds)``. A query without conditions is one row with a null ``col`` and
``n_conds`` 0.

The generators draw from column statistics. Each query is made inside its own
row (the statistics travel as one array, a struct per column), so generating
needs no shuffle, and every draw is a hash of the query, the slot and the
seed, so the same workload comes out on any layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.functions.hashing import hash_key, standard_normal, uniform_index

MALFORMED = ("fail", "drop")
# One statement: SELECT .. FROM table [WHERE column = integer {AND column = integer} or {OR column = integer}] [;]
_NAME = r"(?:`[^`]+`|[A-Za-z_]\w*)"
_CONDITION = rf"({_NAME})\s*=\s*([+-]?\d+)"
_STATEMENT = rf"(?is)^\s*SELECT\s+(?:\*|{_NAME}(?:\s*,\s*{_NAME})*)\s+FROM\s+{_NAME}(?:\.{_NAME})*(?:\s+WHERE\s+(\S.*?))?\s*;?\s*$"
WORKLOAD_SCHEMA = "query_id long, connector string, cond_no int, col string, val long, n_conds int"
MAX_SELECTED = 3


def workload_from_dicts(spark: SparkSession, queries: list[dict], connector: str = "AND") -> DataFrame:
    """A workload from ``{column: constant}`` dicts; an empty dict selects nothing."""
    rows = []
    for q, conds in enumerate(queries):
        if not conds:
            rows.append((q, connector, 0, None, None, 0))
        for i, (col, val) in enumerate(conds.items()):
            rows.append((q, connector, i, col, None if val is None else int(val), len(conds)))
    return spark.createDataFrame(rows, WORKLOAD_SCHEMA)


def sampled_constant(stats: Column, *key: Column | str | int) -> Column:
    """An integer constant for a column: normal with its mean and deviation,
    clipped to its range, rounded half to even."""
    drawn = stats["mean"] + stats["std"] * standard_normal(*key)
    clipped = F.greatest(F.least(drawn, stats["max"]), stats["min"])
    return F.bround(clipped, 0).cast("long")


def _known(stats: Column) -> Column:
    parts = [stats[p].isNotNull() for p in ("min", "max", "mean", "std")]
    return parts[0] & parts[1] & parts[2] & parts[3]


def _stats_array(stats: DataFrame, table: str | None) -> Column:
    """All statistics rows as one array value, in column-name order. There is
    one row per column of the profiled table, so its size follows the schema."""
    rows = stats if table is None else stats.where(F.col("table") == table)
    low = F.col("low") if "low" in stats.columns else F.lit(None).cast("long").alias("low")
    packed = F.sort_array(F.collect_list(F.struct("col", "min", "max", "mean", "std", low)))
    return rows.agg(packed.alias("stats")).scalar()


def _queries(spark: SparkSession, stats: DataFrame, table: str | None, n_queries: int) -> DataFrame:
    return (spark.range(n_queries).withColumnRenamed("id", "query_id")
            .select("query_id", _stats_array(stats, table).alias("stats")))


def sample_constants(stats: DataFrame, n_queries: int, seed: int = 42,
                     table: str | None = None) -> DataFrame:
    """(query_id, col, val): ``n_queries`` constants for every column whose
    statistics are all known."""
    q = _queries(stats.sparkSession, stats, table, n_queries)
    q = q.select("query_id", F.explode("stats").alias("s")).where(_known(F.col("s")))
    val = sampled_constant(F.col("s"), seed, F.col("query_id"), F.col("s.col"))
    return q.select("query_id", F.col("s.col").alias("col"), val.alias("val"))


def generate_workload(stats: DataFrame, n_queries: int, max_conditions: int = 2, seed: int = 42,
                      table: str | None = None) -> DataFrame:
    """Random AND queries over 1 .. ``max_conditions`` different columns.

    A drawn column with an unknown statistic (say the deviation of a one-row
    table) gives no condition; if none is left, a random column is compared
    with its minimum (exact where the statistics have ``low``, see
    ``stats_of``). Without profiled columns the queries are empty.
    """
    qid = F.col("query_id")
    n_cols = F.size("stats")
    drawn = 1 + uniform_index(F.least(F.lit(max_conditions), n_cols), seed, qid, "n_conds")
    shuffled = F.array_sort(F.transform(
        "stats", lambda s: F.struct(hash_key(seed, qid, "pick", s["col"]).alias("order"), s.alias("s"))))
    fallback = F.get("stats", uniform_index(n_cols, seed, qid, "fallback"))

    q = _queries(stats.sparkSession, stats, table, n_queries)
    q = q.select(
        "query_id", "stats",
        F.filter(F.slice(shuffled, 1, drawn), lambda p: _known(p["s"])).alias("picked"))
    conds = F.when(
        F.size("picked") > 0,
        F.transform("picked", lambda p: F.struct(
            p["s"]["col"].alias("col"),
            sampled_constant(p["s"], seed, qid, p["s"]["col"]).alias("val"))),
    ).when(
        n_cols > 0,
        F.array(F.struct(fallback["col"].alias("col"),
                         F.coalesce(fallback["low"], F.bround(fallback["min"], 0).cast("long")).alias("val"))))
    return _one_row_per_condition(q.select("query_id", F.lit("AND").alias("connector"), conds.alias("conds")))


def generate_sql_workload(df_columns: list[str], table: str, stats: DataFrame, n_queries: int,
                          max_conditions: int = 2, id_col: str = "Unique_ID",
                          seed: int = 42) -> DataFrame:
    """Random SELECT statements: (query_id, connector, conds, sql_text).

    1 to 3 random columns are selected, with the id put first when the table
    has it and it was not drawn. The 1 .. ``max_conditions`` conditions may
    repeat a column; one AND or OR joins them all. Without usable conditions
    there is no WHERE. ``sql_conditions`` turns the result into a workload, as
    ``parse_sql_workload`` does from the text alone.
    """
    qid = F.col("query_id")
    n_select = 1 + uniform_index(min(MAX_SELECTED, len(df_columns)), seed, qid, "n_select")
    names = F.array(*[F.lit(c) for c in df_columns])
    ordered = F.array_sort(F.transform(
        names, lambda c: F.struct(hash_key(seed, qid, "select", c).alias("order"), c.alias("c"))))
    selected = F.transform(F.slice(ordered, 1, n_select), lambda p: p["c"])
    if id_col in df_columns:
        selected = F.when(F.array_contains(selected, id_col), selected).otherwise(
            F.concat(F.array(F.lit(id_col)), selected))

    n_conds = 1 + uniform_index(max_conditions, seed, qid, "n_conds")
    slots = F.sequence(F.lit(1), n_conds)
    picked = F.transform(slots, lambda i: F.struct(
        i.alias("slot"), F.get("stats", uniform_index(F.size("stats"), seed, qid, "pick", i)).alias("s")))
    conds = F.transform(F.filter(picked, lambda p: _known(p["s"])), lambda p: F.struct(
        p["s"]["col"].alias("col"),
        sampled_constant(p["s"], seed, qid, p["slot"]).alias("val")))
    connector = F.when(uniform_index(2, seed, qid, "connector") == 0, "AND").otherwise("OR")

    q = _queries(stats.sparkSession, stats, table, n_queries).select(
        "query_id", connector.alias("connector"), F.array_join(selected, ", ").alias("selected"),
        F.coalesce(conds, F.expr("cast(array() as array<struct<col:string,val:bigint>>)")).alias("conds"))
    terms = F.transform("conds", lambda c: F.concat(c["col"], F.lit(" = "), c["val"].cast("string")))
    glue = F.concat(F.lit(" "), F.col("connector"), F.lit(" "))
    where = F.when(F.size("conds") > 0, F.concat(F.lit(" WHERE "), F.call_function("array_join", terms, glue)))
    text = F.concat(F.lit("SELECT "), F.col("selected"), F.lit(f" FROM {table}"),
                    F.coalesce(where, F.lit("")), F.lit(";"))
    return q.select("query_id", "connector", "conds", text.alias("sql_text"))


def sql_conditions(sql_workload: DataFrame) -> DataFrame:
    """The workload rows of generated SELECT statements."""
    return _one_row_per_condition(sql_workload.select("query_id", "connector", "conds"))


def parse_sql_workload(texts: DataFrame, text_col: str = "sql_text", id_col: str = "query_id", on_malformed: str = "fail") -> DataFrame:
    """The workload rows of plain statements, read from their text alone.

    A statement selects columns (or ``*``) from one table, with or without a WHERE in which conditions ``column = integer`` are all
    joined by AND or all by OR; keywords in any case, names plain or in backquotes, columns repeated or not, a ``;`` at the
    end or none. A single condition counts as AND. Anything else is malformed, as are null text and constants
    beyond a long: the job fails and names the query, or (``"drop"``) the statement is left out.
    """
    if on_malformed not in MALFORMED:
        raise ValueError(f"on_malformed must be one of {MALFORMED}, not {on_malformed!r}")
    text = F.col(text_col)
    where = F.regexp_extract(text, _STATEMENT, 1)
    plain = _CONDITION.replace("(`", "(?:`").replace("([+-]", "(?:[+-]")
    joined = rf"(?i)^{plain}(?:(?:\s+AND\s+{plain})*|(?:\s+OR\s+{plain})*)$"
    found = texts.select(F.col(id_col).alias("query_id"), text.alias("text"), where.alias("where")).select(
        "query_id", "text", "where",
        F.when(F.col("where").rlike(rf"(?i)^{plain}\s+OR\s"), "OR").otherwise("AND").alias("connector"),
        F.arrays_zip(F.transform(F.regexp_extract_all("where", F.lit(_CONDITION), 1), lambda c: F.regexp_replace(c, "`", "")).alias("col"),
                     F.transform(F.regexp_extract_all("where", F.lit(_CONDITION), 2), lambda v: v.try_cast("long")).alias("val")).alias("conds"))
    good = F.col("text").rlike(_STATEMENT) & ((F.col("where") == "") | F.col("where").rlike(joined)) & ~F.exists("conds", lambda c: c["val"].isNull())
    good = F.coalesce(good, F.lit(False))
    if on_malformed == "drop":
        found = found.where(good)
    else:
        fail = F.raise_error(F.concat(F.lit("malformed statement of query "), F.coalesce(F.col("query_id").cast("string"), F.lit("null"))))
        found = found.withColumn("connector", F.when(good, F.col("connector")).otherwise(fail.cast("string")))
    return _one_row_per_condition(found.select("query_id", "connector", "conds"))


def _one_row_per_condition(q: DataFrame) -> DataFrame:
    """(query_id, connector, conds) to workload rows."""
    n = F.coalesce(F.greatest(F.size("conds"), F.lit(0)), F.lit(0))
    return q.select("query_id", "connector", n.alias("n_conds"), F.posexplode_outer("conds").alias("cond_no", "c")).select(
        F.col("query_id").cast("long").alias("query_id"), "connector",
        F.coalesce("cond_no", F.lit(0)).cast("int").alias("cond_no"),
        F.col("c.col").alias("col"), F.col("c.val").alias("val"),
        F.col("n_conds").cast("int").alias("n_conds"))


def run_query(spark: SparkSession, sql_text: str) -> DataFrame:
    """Run one generated statement against the registered views."""
    return spark.sql(sql_text.rstrip().rstrip(";"))


