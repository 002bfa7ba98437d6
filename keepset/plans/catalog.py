"""Every operator as a query over the given tables, with its oracle in SQL.

Each entry reads whole tables. The oracles are written from the definitions
(CASE sums, self-joins, one round after the other), not from the way the
operators compute them, wherever a whole table allows that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepset.functions import vectors as V
from keepset.operators import clara as C
from keepset.operators import columns as cols
from keepset.operators import importance as imp
from keepset.operators import kcenter as K
from keepset.operators import medoids as M
from keepset.operators import points as P
from keepset.operators import popularity as pop
from keepset.operators import reduced as red
from keepset.operators import stats as st
from keepset.operators import workload as W
from keepset.plans import sqltext as Q
from keepset.session import scratch_path
from keepset.sources import runlog, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.read_parquet(spark, f"{sf_dir}/{table}.parquet")


# -- fixed parameters ------------------------------------------------------

LINE_FEATURES = ["l_quantity", "l_linenumber", "l_suppkey"]
CUSTOMER_FEATURES = ["c_nationkey", "c_acctbal"]
EVENT_FEATURES = ["event_id", "value"]

SMALL = [{"l_quantity": 10}, {"l_linenumber": 3, "l_suppkey": 7}, {"l_suppkey": 42},
         {"l_quantity": 25, "l_linenumber": 5}, {"l_quantity": 10, "l_linenumber": 1, "l_suppkey": 3}]
SINGLE = [{"l_quantity": v} for v in range(0, 60)] + [{"l_suppkey": v} for v in range(0, 120, 2)]
MULTI = ([{"l_quantity": 1 + v % 50, "l_suppkey": 7 * v % 100} for v in range(60)]
         + [{"l_linenumber": 1 + v % 7, "l_quantity": 1 + 11 * v % 50, "l_suppkey": 13 * v % 100} for v in range(40)]
         + [{"l_linenumber": 1 + v % 8, "l_suppkey": v} for v in range(20)] + [{"l_quantity": 30}] * 3)
CUSTOMERS = [{"c_nationkey": 3}, {"c_nationkey": 7}, {"c_nationkey": 7, "c_acctbal": 0}, {"c_nationkey": 12}]
WITH_NULLS = [{"c_nationkey": None}, {"c_nationkey": 5}, {"c_nationkey": None, "half": None},
              {"c_nationkey": 8, "half": 4}, {"half": None}, {"c_custkey": 20, "c_nationkey": None}]
NULLABLE = ("SELECT c_custkey, nullif(c_nationkey, 0) AS c_nationkey,"
            " CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey / 2 END AS half FROM customer")


# -- features --------------------------------------------------------------

def _kinds() -> str:
    wanted = [("integral", ["o_custkey"]), ("profiled", ["o_custkey", "o_totalprice"]),
              ("any", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])]
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, '{c}' AS col, count({c}) AS filled FROM orders"
                              for k, names in wanted for c in names)


@query("feature_columns", _kinds())
def feature_columns(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    named = {k: cols.numeric_columns(orders, ["o_orderkey"], k) for k in cols.KINDS}
    counts = orders.agg(*[F.count(c).alias(c) for c in named["any"]])
    lines = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("col"), F.col(c).alias("filled"))
             for k, names in named.items() for c in names]
    return counts.select(F.inline(F.array(*lines)))


@query("features_double", "SELECT c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_acctbal FROM customer")
def features_double(spark, sf_dir):
    return cols.feature_doubles(read(spark, sf_dir, "customer"), "c_custkey", ["c_custkey", *CUSTOMER_FEATURES])


@query("feature_array", """
    SELECT p_partkey, 0 AS pos, p_size::DOUBLE AS x FROM part
    UNION ALL SELECT p_partkey, 1 AS pos, p_retailprice AS x FROM part""")
def feature_array(spark, sf_dir):
    arrays = cols.feature_arrays(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return arrays.select("p_partkey", F.posexplode("features").alias("pos", "x"))


@query("features_dropna", f"""
    SELECT c_custkey, c_nationkey::DOUBLE AS c_nationkey, half::DOUBLE AS half FROM (
        SELECT c_custkey, nullif(c_nationkey, 0) AS c_nationkey,
               CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey // 2 END AS half FROM customer)
    WHERE c_nationkey IS NOT NULL AND half IS NOT NULL""")
def features_dropna(spark, sf_dir):
    return cols.feature_doubles(_nullable(spark, sf_dir), "c_custkey", ["c_nationkey", "half"], on_null="drop")


def _nullable(spark, sf_dir) -> DataFrame:
    n = F.col("c_nationkey")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif(n, F.lit(0)).alias("c_nationkey"),
        F.when(n % 2 == 0, (n / 2).cast("int")).alias("half"))


@query("features_nonzero", """
    SELECT c_custkey, c_nationkey, debt FROM (
        SELECT c_custkey, c_nationkey, greatest(-c_acctbal, 0::DOUBLE) AS debt FROM customer)
    WHERE c_nationkey <> 0 OR debt <> 0""")
def features_nonzero(spark, sf_dir):
    debts = read(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.greatest(-F.col("c_acctbal"), F.lit(0.0)).alias("debt"))
    return cols.nonzero_rows(debts, ["c_nationkey", "debt"])


@query("l2_normalize", """
    SELECT vec_id, (i - 1)::INTEGER AS pos, round(e[i] / CASE WHEN n = 0 THEN 1e-9::DOUBLE ELSE n END, 9) AS x
    FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n, unnest(range(1, len(e) + 1)) AS i
          FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""")
def l2_normalize(spark, sf_dir):
    units = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(V.l2_normalize(F.col("embedding").cast("array<double>"))).alias("pos", "x"))
    return units.select("vec_id", "pos", F.round("x", 9).alias("x"))


@query("subset_rows", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_custkey, o_orderkey, o_totalprice LIMIT 1000""")
def subset_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return cols.first_rows(orders, 1000, ["o_custkey"])


@query("pca_lengths", f"""
    WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    base AS (SELECT v AS b FROM e ORDER BY id LIMIT 1)
    SELECT id, round({Q.dot("v", "v")}, 6) AS squared_length, round({Q.dot("v", "b")}, 6) AS with_first FROM e, base""")
def pca_lengths(spark, sf_dir):
    """With all components kept, lengths and products are those of the features."""
    scores = P.pca_points(_embedding_points(spark, sf_dir), 64)
    dims = P.dims_of(scores)
    own = [F.col(v) for v in dims]
    first = [F.lit(x) for x in scores.select(F.min_by(F.array(*own), "id")).first()[0]]  # one row
    return scores.select("id", F.round(V.dot_columns(own, own), 6).alias("squared_length"),
                         F.round(V.dot_columns(own, first), 6).alias("with_first"))


@query("pca_features")
def pca_features(spark, sf_dir):
    scores = P.pca_points(_embedding_points(spark, sf_dir), 8)
    return scores.select("id", *[F.round(F.abs(v), 6).alias(f"abs_{v}") for v in P.dims_of(scores)])


def _embedding_points(spark, sf_dir) -> DataFrame:
    """The embeddings as a table of 64 feature columns."""
    wide = read(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(64)])
    return P.feature_points(wide, "vec_id", [f"e{i}" for i in range(64)])


# -- sources ---------------------------------------------------------------

@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    customer.write.csv(path, header=True)
    return tables.read_csv(spark, path, customer.schema)


def _event_runs(spark, sf_dir) -> DataFrame:
    """One log line per event: running times taken from the event values."""
    return read(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), (F.col("user_id") + 1).alias("n_rows"),
        F.lit(len(EVENT_FEATURES)).alias("n_columns"), (F.col("event_id") % 5 + 1).alias("n_queries"),
        F.lit(1).alias("max_conditions"), F.col("value").alias("time_seconds"))


@query("runlog_append", """
    SELECT n_rows, n_queries, max(n) AS lines, round(sum(s), 4) AS total_seconds FROM (
        SELECT user_id + 1 AS n_rows, event_id % 5 + 1 AS n_queries, 2 * count(*) AS n, 2 * sum(value) AS s
        FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def runlog_append(spark, sf_dir):
    path = scratch_path(spark, "runs")
    for _ in range(2):
        runlog.append_runs(_event_runs(spark, sf_dir), path)
    return runlog.read_runs(spark, path).groupBy("n_rows", "n_queries").agg(
        F.count("*").alias("lines"), F.round(F.sum("time_seconds"), 4).alias("total_seconds"))


@query("runlog_curves", """
    SELECT (event_id % 5 + 1)::DOUBLE AS series, (user_id + 1)::DOUBLE AS size, value AS seconds
    FROM events ORDER BY 1, 2, 3""")
def runlog_curves(spark, sf_dir):
    path = scratch_path(spark, "runs-csv")
    _event_runs(spark, sf_dir).select(
        "timestamp", F.col("n_rows").cast("double"), F.col("n_queries").cast("double"),
        F.lit(1.0), "time_seconds").write.csv(path)
    return runlog.runtime_curves(runlog.read_runs_csv(spark, path))


# -- statistics and workloads ----------------------------------------------

STATS_OF = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"],
            "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
            "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_discount", "l_tax"]}


@query("column_stats", "SELECT \"table\", col, min, max, round(mean, 4) AS mean, round(std, 4) AS std FROM ("
       + " UNION ALL ".join(Q.stats(t, c) for t, c in STATS_OF.items()) + ")")
def column_stats(spark, sf_dir):
    found = st.column_stats({t: read(spark, sf_dir, t) for t in STATS_OF})
    return found.select("table", "col", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _stats(spark, sf_dir, table: str, exclude: list[str] = ()) -> DataFrame:
    return st.column_stats({table: read(spark, sf_dir, table)}, exclude)


@query("workload_values", f"""
    WITH s AS ({Q.stats("orders", STATS_OF["orders"])}), q AS (SELECT range AS query_id FROM range(2000))
    SELECT query_id, col, {Q.constant("s", 42, "query_id", "col")} AS val FROM q, s""")
def workload_values(spark, sf_dir):
    return W.sample_constants(_stats(spark, sf_dir, "orders"), 2000)


LINE_STATS = [c for c in STATS_OF["lineitem"] if c in LINE_FEATURES]


def _generated(n: int, max_conditions: int) -> str:
    drawn = Q.uniform(42, "query_id", "'n_conds'")
    return f"""
    SELECT query_id, 'AND' AS connector, (place - 1)::INTEGER AS cond_no, col, val, n_conds FROM (
        SELECT query_id, s.col, {Q.constant("s", 42, "query_id", "s.col")} AS val,
               (1 + floor({drawn} * least({max_conditions}, (SELECT count(*) FROM s))))::INTEGER AS n_conds,
               row_number() OVER (PARTITION BY query_id
                                  ORDER BY md5(concat_ws('|', 42, query_id, 'pick', s.col)), s.col) AS place
        FROM (SELECT range AS query_id FROM range({n})) q, s)
    WHERE place <= n_conds"""


@query("workload_dicts", f"WITH s AS ({Q.stats('lineitem', LINE_STATS)}) {_generated(2000, 3)}")
def workload_dicts(spark, sf_dir):
    return W.generate_workload(_line_stats(spark, sf_dir), 2000, 3)


def _line_stats(spark, sf_dir) -> DataFrame:
    return st.column_stats({"lineitem": read(spark, sf_dir, "lineitem").select(*LINE_FEATURES)})


def _generated_sql(n: int, max_conditions: int) -> str:
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    listed = ", ".join(f"('{c}')" for c in names)
    return f"""
    WITH s AS ({Q.stats("orders", STATS_OF["orders"])}),
    numbered AS (SELECT s.*, row_number() OVER (ORDER BY col) - 1 AS place FROM s),
    q AS (SELECT range AS query_id,
                 1 + floor({Q.uniform(42, "range", "'n_select'")} * 3)::INTEGER AS n_select,
                 1 + floor({Q.uniform(42, "range", "'n_conds'")} * {max_conditions})::INTEGER AS n_conds,
                 CASE WHEN floor({Q.uniform(42, "range", "'connector'")} * 2) = 0 THEN 'AND' ELSE 'OR' END AS connector
          FROM range({n})),
    selected AS (
        SELECT query_id, string_agg(c, ', ' ORDER BY place) AS listed, bool_or(c = 'o_orderkey') AS has_id
        FROM (SELECT query_id, n_select, c, row_number() OVER (
                  PARTITION BY query_id ORDER BY md5(concat_ws('|', 42, query_id, 'select', c)), c) AS place
              FROM q, (VALUES {listed}) t(c))
        WHERE place <= n_select GROUP BY query_id),
    conds AS (
        SELECT query_id, string_agg(numbered.col || ' = ' || {Q.constant("numbered", 42, "query_id", "slot")}::VARCHAR,
                                    '#' ORDER BY slot) AS text
        FROM (SELECT query_id, connector, slot,
                     floor({Q.uniform(42, "query_id", "'pick'", "slot")} * {len(STATS_OF["orders"])}) AS place
              FROM (SELECT query_id, connector, unnest(range(1, n_conds + 1)) AS slot FROM q)) p
        JOIN numbered USING (place) GROUP BY query_id)
    SELECT query_id, connector, 'SELECT ' || CASE WHEN has_id THEN '' ELSE 'o_orderkey, ' END || listed
           || ' FROM orders WHERE ' || replace(text, '#', ' ' || connector || ' ') || ';' AS sql_text
    FROM q JOIN selected USING (query_id) JOIN conds USING (query_id)"""


@query("workload_sql", _generated_sql(1000, 3))
def workload_sql(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    texts = W.generate_sql_workload(orders.columns, "orders", _stats(spark, sf_dir, "orders"), 1000, 3, "o_orderkey")
    return texts.select("query_id", "connector", "sql_text")


TEXT = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = 26 OR l_linenumber = 4;"


@query("run_generated_sql", TEXT.rstrip(";"))
def run_generated_sql(spark, sf_dir):
    tables.register({"lineitem": read(spark, sf_dir, "lineitem")})
    return W.run_query(spark, TEXT)


# -- popularity ------------------------------------------------------------

def _pop_sql(table: str, id_col: str, terms: str) -> str:
    return f"SELECT {id_col} AS id, sum({terms})::BIGINT AS pop FROM {table} GROUP BY 1"


def _lineitem_pop(spark, sf_dir, queries, **options) -> DataFrame:
    return pop.popularity(read(spark, sf_dir, "lineitem"), queries, "l_orderkey", **options)


@query("pop_case", f"SELECT l_orderkey AS id, ({Q.case_sum(SMALL)})::BIGINT AS pop FROM lineitem")
def pop_case(spark, sf_dir):
    return pop.row_popularity(read(spark, sf_dir, "lineitem"), SMALL, "l_orderkey")


@query("pop_rows", f"SELECT l_orderkey AS id, ({Q.case_sum(MULTI)})::BIGINT AS pop FROM lineitem")
def pop_rows(spark, sf_dir):
    """Per row, with more conditions than a sum of CASE terms takes."""
    return pop.row_popularity(read(spark, sf_dir, "lineitem"), MULTI, "l_orderkey")


LIMIT = 2 ** 53  # beyond it a double skips integers
EXACT = ([{"cents": LIMIT + i} for i in range(-2, 12)] + [{"near": LIMIT + i} for i in range(-4, 9)]
         + [{"cents": LIMIT + i, "near": LIMIT + j} for i in range(4) for j in range(4)])
_EXACT_PARTS = (f"{LIMIT} + l_linenumber + CASE WHEN l_suppkey % 2 = 0 THEN {{half}} ELSE 0 END", f"{LIMIT} - 4 + l_linenumber")


def _exact_sql() -> str:
    def term(c, v):
        return f"{c} = {v}::DECIMAL(20, 2)" if c == "cents" else f"{c} = {v}::BIGINT::DOUBLE"
    hits = " + ".join("CASE WHEN " + " AND ".join(term(c, v) for c, v in q.items()) + " THEN 1 ELSE 0 END" for q in EXACT)
    rows = (f"SELECT l_orderkey, ({_EXACT_PARTS[0].format(half='0.5')})::DECIMAL(20, 2) AS cents,"
            f" ({_EXACT_PARTS[1]})::BIGINT::DOUBLE AS near FROM lineitem")
    return _pop_sql(f"({rows})", "l_orderkey", hits)


def _exact_rows(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr(f"cast({_EXACT_PARTS[0].format(half='0.5')} AS decimal(20, 2))").alias("cents"),
        F.expr(f"cast({_EXACT_PARTS[1]} AS double)").alias("near"))


@query("pop_exact", _exact_sql())
def pop_exact(spark, sf_dir):
    """Decimals with fractions and doubles where these skip integers, by CASE terms."""
    return pop.popularity(_exact_rows(spark, sf_dir), EXACT, "l_orderkey")


@query("pop_exact_join", _exact_sql())
def pop_exact_join(spark, sf_dir):
    """The same by the join."""
    return pop.popularity(_exact_rows(spark, sf_dir), EXACT, "l_orderkey", max_case=0)


@query("pop_nullsafe", _pop_sql(f"({NULLABLE.replace(' / 2', ' // 2')})", "c_custkey",
                                Q.case_sum(WITH_NULLS, null_safe=True)))
def pop_nullsafe(spark, sf_dir):
    return pop.popularity(_nullable(spark, sf_dir), WITH_NULLS, "c_custkey", null_safe=True, max_case=0)


@query("pop_null_constant", _pop_sql(f"({NULLABLE.replace(' / 2', ' // 2')})", "c_custkey", Q.case_sum(WITH_NULLS)))
def pop_null_constant(spark, sf_dir):
    return pop.popularity(_nullable(spark, sf_dir), WITH_NULLS, "c_custkey", max_case=0)


@query("pop_single", _pop_sql("lineitem", "l_orderkey", Q.case_sum(SINGLE)))
def pop_single(spark, sf_dir):
    return _lineitem_pop(spark, sf_dir, SINGLE)


@query("pop_multi", _pop_sql("lineitem", "l_orderkey", Q.case_sum(MULTI)))
def pop_multi(spark, sf_dir):
    return _lineitem_pop(spark, sf_dir, MULTI)


@query("pop_or", _pop_sql("lineitem", "l_orderkey", Q.case_sum(MULTI, "OR")))
def pop_or(spark, sf_dir):
    return _lineitem_pop(spark, sf_dir, W.workload_from_dicts(spark, MULTI, "OR"))


@query("pop_empty", _pop_sql("lineitem", "l_orderkey", Q.case_sum(SMALL) + " + 2"))
def pop_empty(spark, sf_dir):
    return _lineitem_pop(spark, sf_dir, [*SMALL, {}, {}], empty_query="all")


@query("pop_no_queries", "SELECT l_orderkey AS id, 0::BIGINT AS pop FROM lineitem GROUP BY 1")
def pop_no_queries(spark, sf_dir):
    return _lineitem_pop(spark, sf_dir, [{}])


@query("pop_sliced", _pop_sql("lineitem", "l_orderkey", Q.case_sum(MULTI)))
def pop_sliced(spark, sf_dir):
    """A workload too large for one broadcast, by a bound lowered to 100 conditions."""
    return _lineitem_pop(spark, sf_dir, MULTI, max_broadcast=100)


@query("pop_outer_merge", _pop_sql("lineitem", "l_orderkey", Q.case_sum(MULTI)))
def pop_outer_merge(spark, sf_dir):
    batches = [MULTI[i:i + 50] for i in range(0, len(MULTI), 50)]
    return pop.merge_by_join([_lineitem_pop(spark, sf_dir, b) for b in batches])


@query("pop_union_batches", _pop_sql("lineitem", "l_orderkey", Q.case_sum(SINGLE)) + " ORDER BY pop DESC, id")
def pop_union_batches(spark, sf_dir):
    batches = [SINGLE[:60], SINGLE[60:]]
    return pop.popularity_in_batches(read(spark, sf_dir, "lineitem"), batches, "l_orderkey")


@query("pop_ranked", _pop_sql("lineitem", "l_orderkey", Q.case_sum(SMALL)) + " ORDER BY pop DESC, id")
def pop_ranked(spark, sf_dir):
    return pop.ranked(_lineitem_pop(spark, sf_dir, SMALL))


@query("pop_generated", f"""
    WITH s AS ({Q.stats("lineitem", LINE_STATS)}), w AS ({_generated(300, 3)}),
    q AS (SELECT query_id, max(CASE WHEN col = 'l_quantity' THEN val END) AS quantity,
                 max(CASE WHEN col = 'l_linenumber' THEN val END) AS line,
                 max(CASE WHEN col = 'l_suppkey' THEN val END) AS supp FROM w GROUP BY 1)
    SELECT l_orderkey AS id, count(q.query_id)::BIGINT AS pop FROM lineitem LEFT JOIN q
      ON coalesce(quantity = l_quantity, TRUE) AND coalesce(line = l_linenumber, TRUE)
     AND coalesce(supp = l_suppkey, TRUE)
    GROUP BY 1""")
def pop_generated(spark, sf_dir):
    return _lineitem_pop(spark, sf_dir, W.generate_workload(_line_stats(spark, sf_dir), 300, 3))


def _text_pop_sql(n: int, max_conditions: int) -> str:
    """Conditions of the generated statements, matched one by one and counted by row and query."""
    matched = " UNION ALL ".join(f"SELECT id, row_no, query_id FROM o JOIN conds ON col = '{c}' AND {c} = val"
                                 for c in STATS_OF["orders"])
    return f"""
    WITH s AS ({Q.stats("orders", STATS_OF["orders"])}),
    numbered AS (SELECT s.*, row_number() OVER (ORDER BY col) - 1 AS place FROM s),
    q AS (SELECT range AS query_id,
                 1 + floor({Q.uniform(42, "range", "'n_conds'")} * {max_conditions})::INTEGER AS n_conds,
                 floor({Q.uniform(42, "range", "'connector'")} * 2) = 0 AS every FROM range({n})),
    slots AS (SELECT query_id, slot, floor({Q.uniform(42, "query_id", "'pick'", "slot")} * {len(STATS_OF["orders"])}) AS place
              FROM (SELECT query_id, unnest(range(1, n_conds + 1)) AS slot FROM q)),
    conds AS (SELECT query_id, numbered.col, {Q.constant("numbered", 42, "query_id", "slot")} AS val
              FROM slots JOIN numbered USING (place)),
    o AS (SELECT o_orderkey AS id, row_number() OVER () AS row_no, o_orderkey, o_custkey, o_totalprice FROM orders),
    hits AS (SELECT id, row_no, query_id, count(*) AS n FROM ({matched}) GROUP BY ALL),
    found AS (SELECT id, count(*) AS pop FROM hits JOIN q USING (query_id) WHERE n = n_conds OR NOT every GROUP BY 1)
    SELECT id, coalesce(pop, 0)::BIGINT AS pop FROM (SELECT DISTINCT id FROM o) LEFT JOIN found USING (id)"""


@query("pop_generated_text", _text_pop_sql(1000, 3))
def pop_generated_text(spark, sf_dir):
    """Statements, AND and OR mixed, as a workload that is read from their text alone."""
    orders = read(spark, sf_dir, "orders")
    texts = W.generate_sql_workload(orders.columns, "orders", _stats(spark, sf_dir, "orders"), 1000, 3, "o_orderkey")
    return pop.popularity(orders, W.parse_sql_workload(texts.select("query_id", "sql_text")), "o_orderkey")


# -- importance ------------------------------------------------------------

def _self_join(table: str, id_col: str, features: list[str]) -> str:
    """Average dissimilarity from the definition: all pairs of other ids."""
    return f"""u AS ({Q.unit_rows(table, id_col, features)}),
    d AS (SELECT a.id, avg(1 - {Q.dot("a.v", "b.v")}) AS avg_dissim FROM u a JOIN u b ON a.id <> b.id GROUP BY 1)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else c for c in df.columns])


@query("avg_dissim", f"WITH {_self_join('customer', 'c_custkey', CUSTOMER_FEATURES)}"
                     " SELECT id, round(avg_dissim, 6) AS avg_dissim FROM d")
def avg_dissim(spark, sf_dir):
    return _rounded(imp.average_dissimilarity(read(spark, sf_dir, "customer"), CUSTOMER_FEATURES, "c_custkey"))


@query("avg_dissim_repeated_ids", f"WITH {_self_join('events', 'user_id', EVENT_FEATURES)}"
                                  " SELECT id, round(avg_dissim, 6) AS avg_dissim FROM d")
def avg_dissim_repeated_ids(spark, sf_dir):
    return _rounded(imp.average_dissimilarity(read(spark, sf_dir, "events"), EVENT_FEATURES, "user_id"))


@query("importance_avg", f"""
    WITH {_self_join("customer", "c_custkey", CUSTOMER_FEATURES)},
    p AS ({_pop_sql("customer", "c_custkey", Q.case_sum(CUSTOMERS))})
    SELECT id, round(avg_dissim, 6) AS avg_dissim, coalesce(pop, 0) AS pop,
           round(coalesce(pop, 0) * avg_dissim, 6) AS importance FROM d LEFT JOIN p USING (id)""")
def importance_avg(spark, sf_dir):
    return _rounded(imp.importance(read(spark, sf_dir, "customer"), CUSTOMERS, CUSTOMER_FEATURES, "c_custkey"))


def _importance_sql(top: int) -> str:
    """From sums of vectors: pairs of a whole lineitem are too many to join."""
    n = len(LINE_FEATURES)
    own = ", ".join(f"sum(v[{i}]) AS s{i}" for i in range(1, n + 1))
    total = ", ".join(f"sum(s{i}) AS t{i}" for i in range(1, n + 1))
    product = " + ".join(f"s{i} * (t{i} - s{i})" for i in range(1, n + 1))
    return f"""
    WITH u AS ({Q.unit_rows("lineitem", "l_orderkey", LINE_FEATURES, f", {Q.case_sum(MULTI)} AS hits")}),
    g AS (SELECT id, count(*) AS n, sum(hits)::BIGINT AS pop, {own} FROM u GROUP BY 1),
    t AS (SELECT sum(n) AS total, {total} FROM g),
    d AS (SELECT id, pop, 1 - ({product}) / (n::DOUBLE * (total - n)::DOUBLE) AS avg_dissim FROM g, t)
    SELECT id, round(avg_dissim, 6) AS avg_dissim, pop, round(pop * avg_dissim, 6) AS importance
    FROM d ORDER BY pop * avg_dissim DESC, id LIMIT {top}"""


@query("importance_top_t", _importance_sql(100))
def importance_top_t(spark, sf_dir):
    return _rounded(imp.importance(read(spark, sf_dir, "lineitem"), MULTI, LINE_FEATURES, "l_orderkey", top=100))


@query("importance_sum", f"""
    WITH u AS ({Q.unit_rows("events", "user_id", EVENT_FEATURES, ", event_id AS row_no, value / 100 AS popularity")}),
    r AS (SELECT a.id, a.row_no, a.popularity * sum(1 - {Q.dot("a.v", "b.v")}) AS importance
          FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id, a.row_no, a.popularity)
    SELECT id, round(importance, 4) AS importance,
           round((SELECT sum(importance) FROM r) / (SELECT count(*) FROM u), 4) AS set_importance FROM r""")
def importance_sum(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        "user_id", (F.col("value") / 100).alias("popularity"), *EVENT_FEATURES)
    return _rounded(imp.summed_importance(events, "popularity", "user_id"), 4)


# -- medoids ---------------------------------------------------------------

SEED = 42


def _unit_sql(table: str) -> str:
    if table == "embeddings":
        norm = "sqrt(list_dot_product(e, e))"
        return (f"SELECT vec_id AS id, list_transform(e, lambda x: x / {norm}) AS v"
                " FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
    return Q.unit_rows("lineitem", "l_orderkey", LINE_FEATURES)


def _seeds(k: int) -> str:
    """Farthest-point seeds, one step per seed: m0 is the first, m1 the first two, .."""
    steps = [f"""m0 AS (SELECT 0 AS cid, id, v FROM u ORDER BY md5(concat_ws('|', {SEED}, id)), id, v LIMIT 1)"""]
    for j in range(1, k):
        steps.append(f"""m{j} AS (SELECT * FROM m{j - 1} UNION ALL (
            SELECT {j} AS cid, id, v FROM (
                SELECT u.id, u.v, max({Q.dot("u.v", "m.v")}) AS best FROM u, m{j - 1} m
                WHERE u.id NOT IN (SELECT id FROM m{j - 1}) GROUP BY u.id, u.v)
            ORDER BY {Q.steps("best")}, id, v LIMIT 1))""")
    return ", ".join(steps)


def _assigned(medoids: str, name: str) -> str:
    """Each row of r (u with a row number) with its nearest medoid."""
    near = Q.dot("r.v", "m.v")
    return f"""{name} AS (SELECT row_no, r.id, r.v, arg_min(m.cid, [-{Q.steps(near)}, m.cid]) AS cid, max({near}) AS sim
        FROM r, {medoids} m GROUP BY row_no, r.id, r.v)"""


def _sums(assigned: str, d: int) -> str:
    sums = ", ".join(f"sum(v[{i}])" for i in range(1, d + 1))
    return f"SELECT cid, count(*) AS n, [{sums}] AS s FROM {assigned} GROUP BY 1"


def _updated(assigned: str, d: int, name: str) -> str:
    return f"""{name}s AS ({_sums(assigned, d)}),
    {name} AS (SELECT cid, id, v FROM (
        SELECT a.cid, a.id, a.v, row_number() OVER (
            PARTITION BY a.cid ORDER BY {Q.steps(Q.dot("a.v", "s.s") + " / s.n")} DESC, a.id, a.v) AS place
        FROM {assigned} a JOIN {name}s s ON a.cid = s.cid) WHERE place = 1)"""


def _with_points(table: str, k: int) -> str:
    return (f"WITH u AS ({_unit_sql(table)}), r AS (SELECT row_number() OVER () AS row_no, id, v FROM u),"
            f" {_seeds(k)}")


def _line_points(spark, sf_dir) -> DataFrame:
    points = P.prepared_points(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_FEATURES, drop_zero=True)
    return P.spread(points)


def _kept(spark: SparkSession, medoids: M.Medoids) -> DataFrame:
    return spark.createDataFrame(medoids.rows(), "cid int, id long")


@query("farthest_point", f"{_with_points('embeddings', 5)} SELECT cid, id FROM m4")
def farthest_point(spark, sf_dir):
    points = P.unit_points(_embedding_points(spark, sf_dir))
    return _kept(spark, M.farthest_point(points, 5, SEED))


@query("farthest_point_repeated_ids", f"{_with_points('lineitem', 5)} SELECT cid, id FROM m4")
def farthest_point_repeated_ids(spark, sf_dir):
    return _kept(spark, M.farthest_point(_line_points(spark, sf_dir), 5, SEED))


@query("assign_clusters", f"{_with_points('embeddings', 5)}, {_assigned('m4', 'a')}"
                          " SELECT id, cid, round(sim, 6) AS sim FROM a")
def assign_clusters(spark, sf_dir):
    points = P.unit_points(_embedding_points(spark, sf_dir))
    seeds = M.farthest_point(points, 5, SEED)
    return _rounded(M.nearest(points, seeds.vectors).select("id", "cid", "sim"))


@query("cluster_sums", f"{_with_points('lineitem', 4)}, {_assigned('m3', 'a')}"
       " SELECT cid, n, round(s[1], 4) AS s0, round(s[2], 4) AS s1, round(s[3], 4) AS s2"
       f" FROM ({_sums('a', 3)})")
def cluster_sums(spark, sf_dir):
    points = _line_points(spark, sf_dir)
    seeds = M.farthest_point(points, 4, SEED)
    return _rounded(M.cluster_sums(M.nearest(points, seeds.vectors)), 4)


@query("medoid_update", f"{_with_points('lineitem', 4)}, {_assigned('m3', 'a')}, {_updated('a', 3, 'b')}"
       " SELECT cid, id, round(v[1], 6) AS v0, round(v[2], 6) AS v1, round(v[3], 6) AS v2 FROM b")
def medoid_update(spark, sf_dir):
    points = _line_points(spark, sf_dir)
    seeds = M.farthest_point(points, 4, SEED)
    moved = M.medoid_update(points, seeds)
    rows = [(c, r["id"], r["v0"], r["v1"], r["v2"]) for c, r in moved.items()]
    return _rounded(spark.createDataFrame(rows, "cid int, id long, v0 double, v1 double, v2 double"))


@query("clustering_cost", f"""
    {_with_points("lineitem", 4)}, {_assigned("m3", "a")}, {_assigned("m1", "b")}
    SELECT 0 AS restart, round(sum(1 - sim), 4) AS cost FROM a
    UNION ALL SELECT 1 AS restart, round(sum(1 - sim), 4) AS cost FROM b""")
def clustering_cost(spark, sf_dir):
    points = _line_points(spark, sf_dir)
    seeds = M.farthest_point(points, 4, SEED)
    return _rounded(M.clustering_cost(points, [seeds.vectors, seeds.vectors[:2]]), 4)


PAM_ROUNDS = 20  # the default; rounds after the last change alter nothing


def _pam_sql(k: int, d: int) -> str:
    parts, medoids = [_with_points("lineitem", k)], f"m{k - 1}"
    for i in range(PAM_ROUNDS):
        parts += [_assigned(medoids, f"a{i}"), _updated(f"a{i}", d, f"p{i}")]
        medoids = f"p{i}"
    return ", ".join(parts) + f" SELECT cid, id FROM {medoids}"


@query("medoids_pam", _pam_sql(4, 3))
def medoids_pam(spark, sf_dir):
    return M.pam_medoids(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_FEATURES, 4, seed=SEED)


@query("clara_samples", f"""
    SELECT restart, id, round(v[1], 6) AS v0, round(v[2], 6) AS v1, 1::BIGINT AS copies
    FROM ({Q.unit_rows("customer", "c_custkey", CUSTOMER_FEATURES)}), (SELECT range::INTEGER AS restart FROM range(4))
    WHERE {Q.uniform(f"restart + {SEED}", "id")} < 0.2""")
def clara_samples(spark, sf_dir):
    points = P.prepared_points(read(spark, sf_dir, "customer"), "c_custkey", CUSTOMER_FEATURES)
    return _rounded(C.clara_samples(points, 0.2, 4, SEED, unique_ids=True))


@query("clara_samples_folded", f"""
    SELECT restart, id, round(v[1], 6) AS v0, round(v[2], 6) AS v1, round(v[3], 6) AS v2,
           greatest(1, round(n * 0.2::DOUBLE))::BIGINT AS copies
    FROM (SELECT id, v, count(*) AS n FROM ({Q.unit_rows("lineitem", "l_orderkey", LINE_FEATURES)}) GROUP BY 1, 2),
         (SELECT range::INTEGER AS restart FROM range(4))
    WHERE {Q.uniform(f"restart + {SEED}", "id", *[Q.steps(f"v[{i}]") + "::BIGINT" for i in (1, 2, 3)])} < n * 0.2::DOUBLE""")
def clara_samples_folded(spark, sf_dir):
    points = P.prepared_points(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_FEATURES)
    return _rounded(C.clara_samples(points, 0.2, 4, SEED))


CLARA_ROUNDS = 50  # the most a sample takes


def _clara_sql(table: str, id_col: str, cols: list[str], k: int, size: int = 20_000, restarts: int = 8) -> str:
    """The samples of all restarts clustered side by side, then the set of least cost over the whole table."""
    d = range(1, len(cols) + 1)
    drawn = Q.uniform(f"restart + {SEED}", "id", *[Q.steps(f"v[{i}]") + "::BIGINT" for i in d])
    near = Q.dot("s.v", "m.v")
    parts = [f"""WITH u AS ({Q.unit_rows(table, id_col, cols)}), f AS (SELECT least(1::DOUBLE, {max(size, 2 * k)} / count(*)::DOUBLE) AS share FROM u),
    s AS (SELECT row_number() OVER () AS row_no, restart, id, v, greatest(1, round(n * share)) AS copies
          FROM (SELECT id, v, count(*) AS n FROM u GROUP BY 1, 2), f, (SELECT range::INTEGER AS restart FROM range({restarts})) WHERE {drawn} < n * share),
    m0 AS (SELECT restart, 0 AS cid, id, v FROM s QUALIFY row_number() OVER (PARTITION BY restart ORDER BY md5(concat_ws('|', restart + {SEED}, id)), id, v) = 1)"""]
    for j in range(1, k):
        parts.append(f"""m{j} AS (SELECT * FROM m{j - 1} UNION ALL (
            SELECT restart, {j} AS cid, id, v FROM (
                SELECT s.restart, s.id, s.v, max({near}) AS best FROM s JOIN m{j - 1} m ON s.restart = m.restart
                GROUP BY s.restart, s.row_no, s.id, s.v HAVING NOT bool_or(s.id = m.id))
            QUALIFY row_number() OVER (PARTITION BY restart ORDER BY {Q.steps("best")}, id, v) = 1))""")
    medoids, sums = f"m{k - 1}", ", ".join(f"sum(copies * v[{i}])" for i in d)
    for i in range(CLARA_ROUNDS):
        parts += [f"""a{i} AS (SELECT s.restart, row_no, s.id, s.v, copies, arg_min(m.cid, [-{Q.steps(near)}, m.cid]) AS cid
                  FROM s JOIN {medoids} m ON s.restart = m.restart GROUP BY s.restart, row_no, s.id, s.v, copies)""",
                  f"c{i} AS (SELECT restart, cid, sum(copies) AS n, [{sums}] AS s FROM a{i} GROUP BY 1, 2)",
                  f"""p{i} AS (SELECT a.restart, a.cid, a.id, a.v FROM a{i} a JOIN c{i} c ON a.restart = c.restart AND a.cid = c.cid
                  QUALIFY row_number() OVER (PARTITION BY a.restart, a.cid ORDER BY {Q.steps(Q.dot("a.v", "c.s") + " / c.n")} DESC, a.id, a.v) = 1)"""]
        medoids = f"p{i}"
    cost = f"""SELECT restart, sum(n * (1 - sim)) AS cost FROM (
        SELECT restart, g.id, g.v, n, max({Q.dot("g.v", "m.v")}) AS sim FROM (SELECT id, v, count(*) AS n FROM u GROUP BY 1, 2) g, {medoids} m GROUP BY 1, 2, 3, 4) GROUP BY 1"""
    return ", ".join(parts) + f" SELECT cid, id FROM {medoids} WHERE restart = (SELECT arg_min(restart, [cost, restart]) FROM ({cost}))"


@query("medoids_clara", _clara_sql("lineitem", "l_orderkey", LINE_FEATURES, 10))
def medoids_clara(spark, sf_dir):
    return C.clara_medoids(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_FEATURES, 10,
                           seed=SEED)


@query("medoids_clara_pca")
def medoids_clara_pca(spark, sf_dir):
    wide = _embedding_points(spark, sf_dir)
    return C.clara_medoids(wide, "id", P.dims_of(wide), 10, pca_k=16, seed=SEED, unique_ids=True)


SHARDS = 100  # the default; it grows from ten million rows on


def _kcenter_sql(k: int, *shards: str) -> str:
    """Farthest points of each shard, one step per CTE, level by level, then among all picks.

    ``shards`` are the numbers of shards of the levels; they may count ``picks0``, the picks of the first level, and so on.
    """
    dealt = Q.uniform(SEED, "'shard'", "id", *[Q.steps(f"v[{i}]") + "::BIGINT" for i in (1, 2, 3)])
    parts, source = [f"WITH l AS MATERIALIZED (SELECT DISTINCT id, v FROM ({_unit_sql('lineitem')}))"], "l"
    for level, number in enumerate(shards):
        b, c = f"b{level}_", f"c{level}_"

        def pick(j: int, order: str) -> str:
            return f"""{c}{j} AS MATERIALIZED (SELECT shard, id, v FROM (SELECT *, row_number() OVER (
                PARTITION BY shard ORDER BY {order}) AS place FROM {b}{j}) WHERE place = 1)"""

        parts += [f"{b}0 AS MATERIALIZED (SELECT id, v, floor({dealt} * {number})::INTEGER AS shard, -2::DOUBLE AS best FROM {source})",
                  pick(0, f"md5(concat_ws('|', {SEED}, id)), id, v")]
        for j in range(1, k):
            near = Q.dot("b.v", "c.v")
            parts += [f"""{b}{j} AS MATERIALIZED (SELECT b.id, b.v, b.shard, greatest(b.best, {near}) AS best
                      FROM {b}{j - 1} b JOIN {c}{j - 1} c ON b.shard = c.shard WHERE b.id <> c.id)""",
                      pick(j, f"{Q.steps('best')}, id, v")]
        source = f"picks{level}"
        picks = " UNION ALL ".join(f"SELECT id, v FROM {c}{j}" for j in range(k))
        parts.append(f"{source} AS MATERIALIZED ({picks})")
    return ", ".join([*parts, f"u AS (SELECT id, v FROM {source})", _seeds(k)]) + f" SELECT cid, id FROM m{k - 1}"


@query("kcenter_sharded", _kcenter_sql(20, str(SHARDS)))
def kcenter_sharded(spark, sf_dir):
    return K.kcenter_medoids(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_FEATURES, 20,
                             seed=SEED)


PER_SHARD = 300  # rows; more of them than shards of the default number hold, and a level with one shard alters nothing


@query("kcenter_tree", _kcenter_sql(
    20, f"(SELECT greatest({SHARDS}, ceil(count(*) / {PER_SHARD}::DOUBLE)) FROM lineitem)",
    *[f"(SELECT ceil(count(*) / {PER_SHARD}::DOUBLE) FROM picks{level})" for level in range(2)]))
def kcenter_tree(spark, sf_dir):
    """More shards than the default number, their picks merged level by level."""
    return K.kcenter_medoids(read(spark, sf_dir, "lineitem"), "l_orderkey", LINE_FEATURES, 20,
                             seed=SEED, rows_per_shard=PER_SHARD)


# -- the reduced table -----------------------------------------------------

@query("pam_reduced_set", f"""
    SELECT l_orderkey, l_quantity, l_linenumber, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_suppkey) AS place
        FROM lineitem WHERE l_orderkey IN (SELECT id FROM ({_pam_sql(4, 3)})))
    WHERE place = 1""")
def pam_reduced_set(spark, sf_dir):
    lineitem = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_FEATURES)
    return red.reduced_set(lineitem, medoids_pam(spark, sf_dir), "l_orderkey")


@query("reduced_set", f"""
    WITH g AS ({_pop_sql("lineitem", "l_orderkey", Q.case_sum(SMALL))}),
    kept AS (SELECT id FROM g ORDER BY pop DESC, id LIMIT 200)
    SELECT l_orderkey, l_quantity, l_linenumber, l_suppkey FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_suppkey) AS place
        FROM lineitem WHERE l_orderkey IN (SELECT id FROM kept))
    WHERE place = 1""")
def reduced_set(spark, sf_dir):
    lineitem = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_FEATURES)
    kept = pop.ranked(pop.popularity(lineitem, SMALL, "l_orderkey")).limit(200)
    return red.reduced_set(lineitem, kept, "l_orderkey")
