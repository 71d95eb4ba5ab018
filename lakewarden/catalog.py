"""The registered queries of the governed layer, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import inference, mining, profile, retrieval
from .plans.documents import build_document_plan
from .plans.gate import GovernedSession, build_plan
from .plans.policy import OPEN, PolicyEngine
from .semantic.compiler import compile_cube, compile_selection, compile_view
from .semantic.model import Registry, parse_document

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "benchmark", "documents", "conversations")

MODEL = """
models:
  - {name: line, source: tpch, table: lineitem, verified: true, columns: [{name: order_key, dataType: bigint, sourceColumn: l_orderkey}, {name: part_key, dataType: bigint, sourceColumn: l_partkey}, {name: price, dataType: double, sourceColumn: l_extendedprice}, {name: quantity, dataType: double, sourceColumn: l_quantity}, {name: returnflag, dataType: string, sourceColumn: l_returnflag}]}
  - {name: orders, source: tpch, table: orders, verified: true, columns: [{name: o_orderkey, dataType: bigint, isPrimaryKey: true}, {name: o_custkey, dataType: bigint}, {name: o_orderstatus, dataType: string}, {name: o_totalprice, dataType: double}, {name: o_orderpriority, dataType: string}]}
  - {name: customer, source: tpch, table: customer, columns: [{name: c_custkey, dataType: bigint, isPrimaryKey: true}, {name: c_name, dataType: string}, {name: c_nationkey, dataType: int}, {name: c_acctbal, dataType: double}, {name: c_mktsegment, dataType: string}]}
  - {name: nation, source: tpch, table: nation, verified: true, columns: [{name: n_nationkey, dataType: int, isPrimaryKey: true}, {name: n_name, dataType: string}, {name: n_regionkey, dataType: int}]}
  - {name: region, source: tpch, table: region, verified: true, columns: [{name: r_regionkey, dataType: int, isPrimaryKey: true}, {name: r_name, dataType: string}]}
relationships:
  - {name: line_orders, fromModel: line, toModel: orders, cardinality: many-to-one, joinKeys: [{fromColumn: order_key, toColumn: o_orderkey}]}
  - {name: orders_customer, fromModel: orders, toModel: customer, cardinality: many-to-one, joinKeys: [{fromColumn: o_custkey, toColumn: c_custkey}]}
  - {name: customer_nation, fromModel: customer, toModel: nation, cardinality: many-to-one, joinKeys: [{fromColumn: c_nationkey, toColumn: n_nationkey}]}
  - {name: nation_region, fromModel: nation, toModel: region, cardinality: many-to-one, joinKeys: [{fromColumn: n_regionkey, toColumn: r_regionkey}]}
metrics:
  - {name: revenue, model: line, expression: SUM(price)}
  - {name: line_count, model: line, expression: COUNT(*)}
  - {name: parts, model: line, expression: COUNT(DISTINCT part_key)}
  - {name: mean_quantity, model: line, expression: AVG(quantity)}
  - {name: least_price, model: line, expression: MIN(price)}
  - {name: most_price, model: line, expression: MAX(price)}
  - {name: order_count, model: orders, expression: COUNT(o_orderkey)}
views:
  - {name: nations, model: nation, columns: [n_nationkey, n_name]}
cubes:
  - {name: status, model: orders, dimensions: [o_orderstatus], measures: [order_count]}
"""
POLICY = {
    "roles": {
        "one": {"rowFilters": [{"name": "nation", "model": "customer", "column": "c_nationkey", "operator": "eq", "value": 2}], "hiddenColumns": [{"name": "money", "model": "customer", "columns": ["c_acctbal"]}]},
        "some": {"rowFilters": [{"name": "segment", "model": "customer", "column": "c_mktsegment", "operator": "in", "values": ["BUILDING", "MACHINERY"]}]},
        "range": {"rowFilters": [{"name": "rich", "model": "customer", "column": "c_acctbal", "operator": "gte", "value": 1000.0}, {"name": "not", "model": "customer", "column": "c_nationkey", "operator": "neq", "value": 3}]},
        "null": {"rowFilters": [{"name": "nothing", "model": "customer", "column": "c_nationkey", "operator": "eq", "value": None}]},
    },
    "principals": {"ann": {"roles": ["one"]}, "bob": {"roles": ["some"]}, "cy": {"roles": ["range"]}, "dee": {"roles": ["null"]}, "eve": {"roles": ["some", "range"]}},
}
LOG = (
    "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'",
    "SELECT o.o_orderstatus, COUNT(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY o.o_orderstatus",
    "SELECT COUNT(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE  o.o_orderstatus = 'f'",
    "SELECT n_name FROM nation WHERE n_regionkey > 1 ORDER BY n_name LIMIT 3",
    "SELECT n_name FROM nation WHERE n_regionkey > 1",
    "SELECT c_name FROM customer WHERE c_acctbal > 0",
    "NOT A QUERY",
)


def registry() -> Registry:
    return Registry([parse_document(MODEL)])


_SESSIONS: dict[tuple, GovernedSession] = {}


def session(spark: SparkSession, sf_dir: str, principal: str | None = None, tables=TABLES) -> GovernedSession:
    """The source as a principal sees it. Sessions are kept, one a source and principal, as a service keeps them."""
    key = (spark.sparkContext.applicationId, sf_dir, principal, tables)
    if key not in _SESSIONS:
        frames = {t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables}
        _SESSIONS[key] = GovernedSession(spark, frames, PolicyEngine(POLICY).resolve(principal) if principal else OPEN, registry())
    return _SESSIONS[key]


def _sql(sql: str, principal: str | None = None, params=(), whole: bool = False) -> Callable:
    """A governed query; whole: the whole result, as an administrator's golden run has it, for what is no test of the limit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, principal)
        if whole:
            from .plans.gate import analyse
            from .plans.syntax import parse

            return analyse(s, parse(s.spark, sql), params)
        return build_plan(s, sql, params).frame

    return run


def _metric(metric: str, dims=(), limit: int = 1000, principal: str | None = None) -> Callable:
    return lambda spark, sf: compile_selection(session(spark, sf, principal), registry(), metric, dims, limit).frame


def _doc(payload: dict, principal: str | None = None) -> Callable:
    return lambda spark, sf: build_document_plan(session(spark, sf, principal), payload).plan.frame


def _agg(collection: str, pipeline: list, principal: str | None = None) -> Callable:
    return _doc({"operation": "aggregate", "collection": collection, "pipeline": pipeline}, principal)


def _profile(table: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = profile.profile(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        tops = F.array_join(F.transform("topValues", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), ",")
        return d.select("column", "total", "distinctCount", "nullRate", tops.alias("top"))

    return run


def _profile_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total, count(DISTINCT {c}) AS "distinctCount", CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c}))::DOUBLE / count(*) END AS "nullRate",
        CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 50 THEN (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) END AS top FROM {table}"""
        for c in columns
    )


def _numeric_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.profile(spark.read.parquet(f"{sf_dir}/customer.parquet"), ["c_custkey", "c_nationkey"])
    return d.select("column", F.col("min").cast("long").alias("lo"), F.col("max").cast("long").alias("hi"))


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return inference.overlap(read("orders"), "o_custkey", read("customer"), "c_custkey")


def _log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LOG, 1)), "line int, sql string")


def _mine_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(j["left"], j["right"], j["frequency"]) for j in mining.mine(spark, _log(spark)).joins], "left string, right string, frequency long")


def _mine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m["model"], m["expression"], m["frequency"]) for m in mining.mine(spark, _log(spark)).metrics], "model string, expression string, frequency long")


QUESTION = "the hethe and inger with onthe 42"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


TOP = 100


def _top(scores: Callable) -> Callable:
    """The TOP best documents, of equal scores (six decimals) the least ids."""
    return lambda spark, sf: retrieval.top(scores(_texts(spark, sf), QUESTION).select("id", F.round("score", 6).alias("score")), TOP)


def _embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.embed(_texts(spark, sf_dir), "id", "text").select("id", F.col("slot").cast("long").alias("slot"), "value")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    six = lambda x: x.select("id", F.round("score", 6).alias("score"))
    return retrieval.fuse(six(retrieval.bm25(d, QUESTION)), six(retrieval.cosine(d, QUESTION))).select("id", F.round("score", 6).alias("score"))


def _question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import question_id

    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.groupBy(question_id(F.col("text")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def _schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.registry import infer_documents

    return infer_documents(spark.read.parquet(f"{sf_dir}/events.parquet"), "props").select("path", "types", "nullable")


def _frame(compile_, name: str) -> Callable:
    return lambda spark, sf: compile_(session(spark, sf), registry(), name).frame


_TOKENS = "unnest(regexp_extract_all(lower({t}), '[a-z_][a-z0-9_]*|[0-9]+'))"
_TERMS = ", ".join(f"'{t}'" for t in sorted(set(QUESTION.split())))
_BM25 = """WITH d AS (SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*|[0-9]+') AS t FROM {table}),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS a FROM d), tf AS (SELECT id, len(t) AS l, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM tf JOIN df USING (term), n GROUP BY id"""
_VECTORS = """SELECT id, slot, sum(sign) AS value FROM (SELECT {id} AS id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 128 AS slot, CASE WHEN ('0x' || substr(sha256(term), 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
FROM (SELECT {id}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*|[0-9]+')) AS term FROM {table})) GROUP BY id, slot HAVING sum(sign) <> 0"""
_COSINE = (
    "WITH v AS ({v}), q AS ({q}), s AS (SELECT v.id, sum(v.value * coalesce(q.value, 0)) AS dot, sqrt(sum(v.value * v.value)) AS n FROM v LEFT JOIN q USING (slot) GROUP BY v.id) "
    "SELECT d.{id} AS id, coalesce(dot / (n * (SELECT sqrt(sum(value * value)) FROM q)), 0.0) AS score FROM {table} d LEFT JOIN s ON s.id = d.{id}"
)


def _cosine_sql(table: str, key: str) -> str:
    q = _VECTORS.format(id="id", table=f"(SELECT 0 AS id, '{QUESTION}' AS text)").replace("SELECT id, slot", "SELECT slot", 1).replace("GROUP BY id, slot", "GROUP BY slot")
    return _COSINE.format(v=_VECTORS.format(id=key, table=table), q=q, id=key, table=table)


_AGG = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10"
# name: (query, SQL)
_SAME = {
    "join_inner_multi": "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_theta": "SELECT a.n_name AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_name",
    "join_cross": "SELECT count(*) AS n FROM region a CROSS JOIN region b CROSS JOIN region c WHERE a.r_regionkey <> b.r_regionkey",
    "join_outer_full": "SELECT count(*) AS n, count(s_suppkey) AS s, count(c_custkey) AS c FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey + 50",
    "join_semi": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "join_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "join_left": "SELECT n_name, count(s_suppkey) AS s, count(*) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_suppkey % 2 = 0 GROUP BY n_name",
    "join_right": "SELECT n_name, count(s_suppkey) AS s, count(*) AS n FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_suppkey % 2 = 0 GROUP BY n_name",
    "join_range": "SELECT a.p_partkey AS a, count(*) AS n FROM part a JOIN part b ON b.p_size = a.p_size AND b.p_partkey BETWEEN a.p_partkey - 50 AND a.p_partkey + 50 GROUP BY a.p_partkey",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT t.n, count(n_nationkey) AS c FROM t LEFT JOIN nation ON n_nationkey < t.n GROUP BY t.n",
    "cast_colons": "SELECT p_partkey, p_size::bigint AS b, '7'::int AS i, p_name::string AS s FROM part",
    "agg_having": _AGG,
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, max(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "window_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders",
    "window_rank": "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer",
    "window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders",
    "window_frame_sum": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM lineitem",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier",
    "cte_nested": "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT k, n FROM a, b WHERE n = m",
    "scalar_string": "SELECT p_partkey, upper(p_name) AS u, length(p_brand) AS l, substring(p_type, 1, 3) AS s, concat(p_brand, '-', p_type) AS c, p_name ILIKE '%a%' AS a FROM part",
    "scalar_math": "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(p_size AS bigint) AS b, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part",
    "scalar_date": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(o_orderdate AS date) AS d FROM orders",
    "scalar_repeat": "SELECT n_name, repeat(n_name, 2) AS r FROM nation",
}
_PAIRS: dict[str, tuple[Callable, str | None]] = {
    **{k: (_sql(v, whole=True), v) for k, v in _SAME.items()},
    "gate_default_limit_count": (lambda s, d: build_plan(session(s, d), "SELECT l_orderkey FROM lineitem").frame.agg(F.count(F.lit(1)).alias("n")), "SELECT least(count(*), 1000) AS n FROM lineitem"),
    "gate_limit_clamp": (_sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50000"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10000"),
    "gate_limit_preserve": (_sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    "gate_offset": (_sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 20"),
    "gate_union_limit": (lambda s, d: build_plan(session(s, d), "SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders LIMIT 20").frame.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders LIMIT 20)"),
    "gate_subquery_unlimited": (_sql("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"), "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"),
    "rlac_eq": (_sql("SELECT c_custkey, c_name FROM customer", "ann", whole=True), "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 2"),
    "rlac_in": (_sql("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment", "bob"), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment"),
    "rlac_range": (_sql("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey", "cy"), "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal >= 1000 AND c_nationkey <> 3 GROUP BY c_nationkey"),
    "rlac_null": (_sql("SELECT count(*) AS n FROM customer", "dee"), "SELECT count(*) AS n FROM customer WHERE c_nationkey = NULL"),
    "rlac_or_bypass": (_sql("SELECT c_custkey FROM customer WHERE c_nationkey = 2 OR 1 = 1 -- all", "ann", whole=True), "SELECT c_custkey FROM customer WHERE c_nationkey = 2"),
    "rlac_union_arms": (_sql("SELECT c_custkey AS k FROM customer UNION SELECT c_custkey FROM customer WHERE true", "ann", whole=True), "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 2"),
    "rlac_self_join": (_sql("SELECT a.c_custkey AS x, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY a.c_custkey", "ann", whole=True), "SELECT a.c_custkey AS x, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_nationkey = 2 AND b.c_nationkey = 2 GROUP BY a.c_custkey"),
    "rlac_cte_exists": (_sql("WITH x AS (SELECT * FROM customer) SELECT count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM x WHERE x.c_custkey = o.o_custkey)", "ann"), "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 2)"),
    "rlac_multi_role": (_sql("SELECT count(*) AS n FROM customer", "eve"), "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND c_nationkey <> 3"),
    "rlac_left_join_view": (_sql("SELECT o_orderstatus, count(c_custkey) AS matched, count(*) AS rows FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus", "ann"), "SELECT o_orderstatus, count(c_custkey) AS matched, count(*) AS rows FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 2) c ON o_custkey = c_custkey GROUP BY o_orderstatus"),
    "rlac_left_join_where": (_sql("SELECT o_orderstatus, count(c_custkey) AS matched, count(*) AS rows FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL GROUP BY o_orderstatus", "ann"), "SELECT o_orderstatus, count(c_custkey) AS matched, count(*) AS rows FROM orders LEFT JOIN customer c ON o_custkey = c_custkey WHERE c_nationkey = 2 GROUP BY o_orderstatus"),
    "rlac_deny_all_count": (_sql("SELECT count(*) AS n FROM customer", "nobody"), "SELECT 0::BIGINT AS n"),
    "clac_star": (_sql("SELECT * FROM customer", "ann", whole=True), "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 2"),
    "clac_star_join": (_sql("SELECT c.*, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "ann", whole=True), "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 2"),
    "bind_params": (_sql("SELECT count(*) AS n FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", params=("F", 1000.0)), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000"),
    "metric_scalar": (_metric("line_count"), "SELECT count(*) AS line_count FROM lineitem"),
    "metric_by_dim": (_metric("line_count", ["line.returnflag"]), "SELECT l_returnflag AS line_returnflag, count(*) AS line_count FROM lineitem GROUP BY 1"),
    "metric_multi_hop": (_metric("line_count", ["nation.n_name", "region.r_name"]), "SELECT n_name AS nation_n_name, r_name AS region_r_name, count(*) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "metric_count_distinct": (_metric("parts", ["line.returnflag"]), "SELECT l_returnflag AS line_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "metric_min": (_metric("least_price"), "SELECT min(l_extendedprice) AS least_price FROM lineitem"),
    "metric_max": (_metric("most_price"), "SELECT max(l_extendedprice) AS most_price FROM lineitem"),
    "metric_avg": (lambda s, d: _metric("mean_quantity")(s, d).select(F.round("mean_quantity", 6).alias("mean_quantity")), "SELECT round(avg(l_quantity), 6) AS mean_quantity FROM lineitem"),
    "metric_limited": (_metric("order_count", ["nation.n_name"], 3), "SELECT n_name AS nation_n_name, count(o_orderkey) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 1 LIMIT 3"),
    "metric_governed": (_metric("order_count", ["nation.n_name"], principal="ann"), "SELECT n_name AS nation_n_name, count(o_orderkey) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 2 GROUP BY 1"),
    "model_view": (_frame(compile_view, "nations"), "SELECT n_nationkey, n_name FROM nation"),
    "model_cube": (_frame(compile_cube, "status"), "SELECT o_orderstatus, count(o_orderkey) AS order_count FROM orders GROUP BY 1"),
    "scalar_json": (_sql("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", whole=True), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "scalar_map": (_sql("SELECT n_nationkey, element_at(map('a', n_nationkey, 'b', n_regionkey), 'b') AS b, cardinality(map_keys(map('a', 1, 'b', 2))) AS k, map_contains_key(map(n_name, 1), 'FRANCE') AS f FROM nation", whole=True), "SELECT n_nationkey, n_regionkey AS b, 2 AS k, n_name = 'FRANCE' AS f FROM nation"),
    "scalar_array": (_sql("SELECT n_nationkey, element_at(array(n_name, 'x'), 1) AS a, size(split(n_name, 'A')) AS s FROM nation", whole=True), "SELECT n_nationkey, n_name AS a, len(string_split(n_name, 'A'))::INT AS s FROM nation"),
    "profile_stats": (_profile("orders"), _profile_sql("orders", ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"))),
    "profile_top_values": (_profile("events"), _profile_sql("events", ("event_id", "user_id", "ts", "event_type", "value", "props"))),
    "profile_numeric_minmax": (_numeric_ends, "SELECT 'c_custkey' AS \"column\", min(c_custkey)::BIGINT AS lo, max(c_custkey)::BIGINT AS hi FROM customer UNION ALL SELECT 'c_nationkey', min(c_nationkey)::BIGINT, max(c_nationkey)::BIGINT FROM customer"),
    "infer_overlap": (_overlap, "WITH c AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL ORDER BY v LIMIT 1000) SELECT count(*) AS sampled, count(p.c_custkey) AS matched FROM c LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) p ON p.c_custkey = c.v"),
    "mine_rules": (lambda s, d: mining.mine_rules(_log(s)), "SELECT * FROM (VALUES ('rule_o_o_orderstatus_f', 'o.o_orderstatus = ''f''', 3::BIGINT), ('rule_n_regionkey_1', 'n_regionkey > 1', 2::BIGINT)) AS t(name, rule, frequency)"),
    "mine_joins": (_mine_joins, "SELECT 'customer.c_custkey' AS \"left\", 'orders.o_custkey' AS \"right\", 3::BIGINT AS frequency"),
    "mine_metrics": (_mine_metrics, "SELECT 'orders' AS model, 'COUNT(*)' AS expression, 2::BIGINT AS frequency"),
    "doc_find": (_doc({"operation": "find", "collection": "events", "filter": {"event_type": {"$in": ["click", "view"]}, "user_id": {"$lte": 50}}, "projection": {"event_id": 1, "user_id": 1}, "sort": {"event_id": 1}, "skip": 2, "limit": 25}), "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND user_id <= 50 ORDER BY event_id LIMIT 25 OFFSET 2"),
    "doc_find_one": (_doc({"operation": "findOne", "collection": "events", "filter": {"event_id": {"$gte": 5}}, "sort": {"event_id": 1}, "projection": {"event_id": 1, "event_type": 1}}), "SELECT event_id, event_type FROM events WHERE event_id >= 5 ORDER BY event_id LIMIT 1"),
    "doc_group": (_doc({"operation": "aggregate", "collection": "events", "pipeline": [{"$match": {"user_id": {"$ne": 3}}}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "most": {"$max": "$user_id"}}}, {"$sort": {"_id": 1}}]}), "SELECT event_type AS _id, count(*) AS n, max(user_id) AS most FROM events WHERE user_id <> 3 GROUP BY 1"),
    "doc_unwind": (_doc({"operation": "aggregate", "collection": "conversations", "pipeline": [{"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}}}, {"$unwind": "$roles"}, {"$group": {"_id": "$roles", "n": {"$sum": 1}}}]}), "SELECT role AS _id, count(*) AS n FROM conversations GROUP BY 1"),
    "doc_lookup": (_doc({"operation": "aggregate", "collection": "region", "pipeline": [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}, {"$project": {"r_name": 1, "n": {"$size": "$nations"}}}]}), "SELECT r_name, count(n_nationkey)::INT AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name"),
    "doc_distinct": (_doc({"operation": "distinct", "collection": "events", "field": "event_type"}), "SELECT DISTINCT event_type AS value FROM events"),
    "doc_count": (_doc({"operation": "countDocuments", "collection": "customer", "filter": {"$or": [{"c_mktsegment": "BUILDING"}, {"c_nationkey": {"$gt": 20}}]}}, "bob"), "SELECT count(*) AS count FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_mktsegment = 'BUILDING' OR c_nationkey > 20)"),
    "doc_facet": (_agg("nation", [{"$facet": {"all": [{"$count": "n"}], "some": [{"$match": {"n_regionkey": 1}}, {"$count": "n"}]}}, {"$project": {"a": {"$arrayElemAt": ["$all.n", 0]}, "b": {"$arrayElemAt": ["$some.n", -1]}}}]), "SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS b"),
    "doc_facet_large": (_agg("lineitem", [{"$facet": {"all": [{"$match": {"l_quantity": {"$gt": 0}}}], "some": [{"$match": {"l_quantity": {"$gt": 25}}}]}}, {"$project": {"a": {"$size": "$all"}, "b": {"$size": "$some"}}}]), "SELECT count(*) FILTER (WHERE l_quantity > 0)::INT AS a, count(*) FILTER (WHERE l_quantity > 25)::INT AS b FROM lineitem"),
    "doc_literal": (_agg("nation", [{"$project": {"n_nationkey": 1, "price": {"$literal": "$5"}}}]), "SELECT n_nationkey, '$5' AS price FROM nation"),
    "doc_first_last": (_agg("orders", [{"$sort": {"o_orderkey": -1}}, {"$group": {"_id": "$o_orderstatus", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}]), "SELECT o_orderstatus AS _id, max(o_orderkey) AS first, min(o_orderkey) AS last FROM orders GROUP BY 1"),
    "doc_first_mixed": (_agg("orders", [{"$sort": {"o_orderpriority": 1, "o_orderkey": -1}}, {"$group": {"_id": "$o_orderstatus", "first": {"$first": "$o_orderkey"}, "n": {"$sum": 1}}}]), "SELECT o_orderstatus AS _id, max(CASE WHEN r = 1 THEN o_orderkey END) AS first, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey DESC) AS r FROM orders) GROUP BY 1"),
    "doc_bucket": (_agg("part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 30], "default": 99, "output": {"n": {"$sum": 1}, "most": {"$max": "$p_partkey"}}}}]), "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN 0 WHEN p_size >= 10 AND p_size < 30 THEN 10 ELSE 99 END AS _id, count(*) AS n, max(p_partkey) AS most FROM part GROUP BY 1"),
    "doc_union_with": (_agg("customer", [{"$project": {"k": "$c_nationkey"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$project": {"k": "$s_nationkey"}}]}}, {"$group": {"_id": "$k", "n": {"$sum": 1}}}], "bob"), "SELECT k AS _id, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "doc_replace_root": (_agg("nation", [{"$replaceRoot": {"newRoot": {"name": "$n_name", "at": {"$add": ["$n_regionkey", 1]}}}}]), "SELECT n_name AS name, n_regionkey + 1 AS at FROM nation"),
    "doc_window_fields": (_agg("nation", [{"$setWindowFields": {"partitionBy": "$n_regionkey", "sortBy": {"n_nationkey": 1}, "output": {"r": {"$documentNumber": {}}, "s": {"$sum": "$n_nationkey", "window": {"documents": ["unbounded", "current"]}}}}}, {"$project": {"n_nationkey": 1, "r": 1, "s": 1}}]), "SELECT n_nationkey, row_number() OVER w AS r, sum(n_nationkey) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)"),
    "doc_expressions": (_agg("orders", [{"$match": {"$expr": {"$gt": ["$o_totalprice", 1000]}, "o_orderkey": {"$mod": [4, 1]}}}, {"$group": {"_id": {"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": "done"}, {"case": {"$in": ["$o_orderstatus", ["O", "P"]]}, "then": "open"}], "default": "?"}}, "n": {"$sum": {"$cond": {"if": {"$and": [{"$gt": ["$o_custkey", 5]}, {"$not": [{"$eq": ["$o_orderpriority", "1-URGENT"]}]}]}, "then": 1, "else": 0}}}}}]), "SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE '?' END AS _id, sum(CASE WHEN o_custkey > 5 AND o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS n FROM orders WHERE o_totalprice > 1000 AND o_orderkey % 4 = 1 GROUP BY 1"),
    "doc_arrays": (_agg("conversations", [{"$group": {"_id": "$conv_id", "roles": {"$push": "$role"}, "turns": {"$push": {"turn": "$turn", "role": "$role"}}}}, {"$match": {"roles": {"$all": ["user", "assistant"]}, "turns": {"$elemMatch": {"turn": {"$gte": 3}, "role": "user"}}}}, {"$project": {"n": {"$size": {"$filter": {"input": "$roles", "as": "r", "cond": {"$eq": ["$$r", "user"]}}}}}}, {"$group": {"_id": "$n", "c": {"$sum": 1}}}]), "SELECT n AS _id, count(*) AS c FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user')::INT AS n FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0 AND count(*) FILTER (WHERE role = 'user' AND turn >= 3) > 0) GROUP BY 1"),
    "doc_schema_infer": (_schema_inference, "SELECT 'k' AS path, 'number' AS types, false AS nullable"),
    "bm25_topk": (_top(retrieval.bm25), f"SELECT id, round(score, 6) AS score FROM ({_BM25.format(id='doc_id', table='documents', terms=_TERMS)}) ORDER BY 2 DESC, 1 LIMIT {TOP}"),
    "embed_hash": (_embedding, _VECTORS.format(id="doc_id", table="documents")),
    "cosine_topk": (_top(retrieval.cosine), f"SELECT id, round(score, 6) AS score FROM ({_cosine_sql('documents', 'doc_id')}) ORDER BY 2 DESC, 1 LIMIT {TOP}"),
    "rrf_fuse": (_fused, f"""WITH l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, round(score, 6) AS score FROM ({_BM25.format(id='doc_id', table='documents', terms=_TERMS)}))),
      w AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, round(score, 6) AS score FROM ({_cosine_sql('documents', 'doc_id')})))
      SELECT w.id, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + 1.0::DOUBLE / (60 + w.r), 6) AS score FROM w LEFT JOIN l USING (id) WHERE coalesce(l.score, 0) > 0 OR w.score > 0 ORDER BY coalesce(1.0::DOUBLE / (60 + l.r), 0) + 1.0::DOUBLE / (60 + w.r) DESC, 1 LIMIT 5"""),
    "question_id_dedup": (_question_ids, "SELECT sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS id, count(*) AS n FROM benchmark GROUP BY 1"),
}
QUERIES = {k: q for k, (q, _) in _PAIRS.items()}
SQL = {k: s for k, (_, s) in _PAIRS.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation as a row-scoped principal sees it."""
    return compile_selection(session(spark, sf_dir, "bob"), registry(), "revenue", ["nation.n_name"]).frame
