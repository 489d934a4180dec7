"""Queries in the query language over the driver's tables, each with the SQL of an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.literals import Clock
from siltline.operators import exchange
from siltline.plans.engine import sql
from siltline.sources.catalog import Catalog, table_catalog
from siltline.sources.records import media_records
from siltline.sources.references import classify
from siltline.sources.tables import read_table
from siltline.streaming.ingest import coverage, frontier, numbered_within, too_old, unknown_rows

#: Relative dates refer to this time, so that results can be repeated.
CLOCK = Clock(datetime(2024, 1, 31, 12, tzinfo=timezone.utc))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _define(name: str, text: str, oracle: str | None, rounded: tuple[str, ...] = (), **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = sql(text, table_catalog(spark, sf_dir), clock=CLOCK, **options)
        for c in rounded:
            found = found.withColumn(c, F.round(c, 2))
        return found

    query.__name__, query.__doc__ = name, text
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


#: Orders with some values taken away.
_D = "(SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS status, NULLIF(o_orderpriority, '1-URGENT') AS priority, o_totalprice FROM orders) AS d"
_S = "(SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS status, NULLIF(o_orderpriority, '1-URGENT') AS priority, o_totalprice FROM orders) d"

# Scans and projection
_define("scan_project", "SELECT o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, o_totalprice FROM orders")
_define("select_star", "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
_define("relation_wildcard", "SELECT b.* FROM nation AS a JOIN region AS b ON a.n_regionkey = b.r_regionkey", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_define("default_projection", "FROM (SELECT o_orderkey AS id, o_totalprice FROM orders) AS x WHERE o_totalprice > 400000", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 400000")
# Predicates
_define("filter_kleene", f"SELECT o_orderkey FROM {_D} WHERE NOT (status = 'O' OR priority = '5-LOW') AND (o_totalprice > 100000 OR status = 'P')", f"SELECT o_orderkey FROM {_S} WHERE NOT (status = 'O' OR priority = '5-LOW') AND (o_totalprice > 100000 OR status = 'P')")
_define("truth_tests", f"SELECT o_orderkey FROM {_D} WHERE (status = 'O') IS UNKNOWN OR (priority = '5-LOW') IS NOT FALSE AND (status = 'P') IS TRUE", f"SELECT o_orderkey FROM {_S} WHERE (status = 'O') IS NULL OR (priority = '5-LOW') IS NOT FALSE AND (status = 'P') IS TRUE")
_define("distinct_from", f"SELECT o_orderkey FROM {_D} WHERE status IS DISTINCT FROM 'O' AND priority IS NOT DISTINCT FROM NULL", f"SELECT o_orderkey FROM {_S} WHERE status IS DISTINCT FROM 'O' AND priority IS NOT DISTINCT FROM NULL")
_define("is_null_tests", f"SELECT o_orderkey FROM {_D} WHERE status IS NULL AND priority IS NOT NULL", f"SELECT o_orderkey FROM {_S} WHERE status IS NULL AND priority IS NOT NULL")
_define("between_bounds", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50_000 AND 60000.5 AND o_orderkey NOT BETWEEN 0x10 AND 0x20", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000.5 AND o_orderkey NOT BETWEEN 16 AND 32")
_define("between_null_bound", f"SELECT o_orderkey FROM {_D} WHERE status NOT BETWEEN NULL AND 'Z'", f"SELECT o_orderkey FROM {_S} WHERE status IS NOT NULL")
_define("in_list", f"SELECT o_orderkey FROM {_D} WHERE status IN ('O', 'P') AND o_orderkey IN (1, 5, 7, 32, 33, 34)", f"SELECT o_orderkey FROM {_S} WHERE status IN ('O', 'P') AND o_orderkey IN (1, 5, 7, 32, 33, 34)")
_define("not_in_null_member", f"SELECT o_orderkey FROM {_D} WHERE status NOT IN ('O', NULL)", f"SELECT o_orderkey FROM {_S} WHERE status <> 'O'")
_define("natural_comparisons", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity AT LEAST 10 AND l_quantity BELOW 12 AND l_discount MORE THAN 0.05", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount > 0.05")
_define("contains_caseless", "SELECT doc_id FROM documents WHERE text CONTAINS 'GARDEN' AND text DOES NOT CONTAIN 'winter'", "SELECT doc_id FROM documents WHERE contains(lower(text), 'garden') AND NOT contains(lower(text), 'winter')")
_define("contains_folded", "SELECT doc_id FROM documents WHERE text CONTAINS 'STRASSE'", "SELECT doc_id FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'strasse')")
_P = "(SELECT p_partkey, CONCAT(p_name, CASE WHEN p_size > 25 THEN '_50%' ELSE ' 500' END) AS label FROM part)"
_define("like_escape", f"SELECT p_partkey FROM {_P} AS x WHERE label LIKE '%\\_50\\%' AND label NOT LIKE 'r_d%'", f"SELECT p_partkey FROM {_P.replace('CONCAT(p_name, ', '(p_name || ')} x WHERE label LIKE '%\\_50\\%' ESCAPE '\\' AND label NOT LIKE 'r_d%'")
_define("ilike_any_case", "SELECT p_partkey FROM part WHERE p_type ILIKE '%brass' OR p_brand ILIKE 'BRAND#1_'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%brass' OR p_brand ILIKE 'BRAND#1_'")
_define("matches_pattern", "SELECT doc_id FROM documents WHERE text MATCHES '#(?P<n>\\\\d+)$' OR text MATCHES '^@[A-Z][a-z]+ ' OR text NOT MATCHES ' '", "SELECT doc_id FROM documents WHERE regexp_matches(text, '#\\p{Nd}+\\n?\\z') OR regexp_matches(text, '^@[A-Z][a-z]+ ') OR NOT regexp_matches(text, ' ')")
_define("column_comparison", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 100 = l_suppkey % 100 + 0", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_partkey % 100 = l_suppkey % 100")
# Scalars
_define("arithmetic_null_division", "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 3) AS q, (l_linenumber - 3) * 2 + 1 AS r FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity / nullif(l_linenumber - 3, 0) AS q, CAST((l_linenumber - 3) * 2 + 1 AS BIGINT) AS r FROM lineitem")
_define("floor_modulo", "SELECT o_orderkey, (3 - o_orderkey) % 7 AS a, o_orderkey % -7 AS b, o_orderkey % 0 AS c FROM orders", "SELECT o_orderkey, CAST(((3 - o_orderkey) % 7 + 7) % 7 AS BIGINT) AS a, CAST((o_orderkey % -7 + -7) % -7 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c FROM orders")
_define("greatest_least_null", f"SELECT o_orderkey, GREATEST(status, priority) AS g, LEAST(status, priority, 'M') AS l FROM {_D}", f"SELECT o_orderkey, CASE WHEN status IS NULL OR priority IS NULL THEN NULL ELSE greatest(status, priority) END AS g, CASE WHEN status IS NULL OR priority IS NULL THEN NULL ELSE least(status, priority, 'M') END AS l FROM {_S}")
_define("nullif_coalesce", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'O'), NULLIF(o_orderpriority, '5-LOW'), 'none') AS v FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderpriority, '5-LOW'), 'none') AS v FROM orders")
_define("concat_null", f"SELECT o_orderkey, CONCAT(status, '/', priority) AS v FROM {_D}", f"SELECT o_orderkey, status || '/' || priority AS v FROM {_S}")
_define("char_codes", "SELECT n_name, CHAR(65 + n_nationkey, 0x1F600, 0o101) AS v, CHAR(55296 + n_nationkey) AS w FROM nation", "SELECT n_name, chr(65 + n_nationkey) || chr(128512) || 'A' AS v, CAST(NULL AS VARCHAR) AS w FROM nation")
_define("case_searched", f"SELECT o_orderkey, CASE WHEN status = 'O' THEN 1 WHEN priority = '5-LOW' THEN 2.5 ELSE 0 END AS v FROM {_D}", f"SELECT o_orderkey, CASE WHEN status = 'O' THEN 1 WHEN priority = '5-LOW' THEN CAST(2.5 AS DOUBLE) ELSE 0 END AS v FROM {_S}")
_define("text_functions", "SELECT doc_id, LENGTH(text) AS n, UPPER(lang) AS u, LOWER(source) AS s FROM documents", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, upper(lang) AS u, lower(source) AS s FROM documents")
_define("number_bases", "SELECT r_name, 0xFF_FF + 0o17 + 0b101 + 1_000 AS v, -r_regionkey AS m FROM region", "SELECT r_name, CAST(65535 + 15 + 5 + 1000 AS BIGINT) AS v, CAST(-r_regionkey AS BIGINT) AS m FROM region")
# Typed literals
_define("timestamp_literals", "SELECT event_id FROM events WHERE ts >= 2024-01-10T00:00:00 AND ts < 2024-01-12T06:30:00+02:00", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 04:30:00'")
_define("relative_timestamp", "SELECT event_id FROM events WHERE ts > NOW()-3d AND ts <= NOW() AND ts < INFINITY()", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-28 12:00:00' AND ts <= TIMESTAMP '2024-01-31 12:00:00'")
# Order and slices
_define("order_nulls_last", f"SELECT status, priority, o_orderkey FROM {_D} ORDER BY status DESC, priority, o_orderkey DESC LIMIT 40 OFFSET 5", f"SELECT status, priority, o_orderkey FROM {_S} ORDER BY status DESC NULLS LAST, priority ASC NULLS LAST, o_orderkey DESC LIMIT 40 OFFSET 5")
_define("order_nulls_tail", f"SELECT status, o_orderkey FROM {_D} ORDER BY status, o_orderkey OFFSET 100", f"SELECT status, o_orderkey FROM {_S} ORDER BY status NULLS LAST, o_orderkey OFFSET 100")
_define("order_by_alias", "SELECT o_orderkey, 0 - o_totalprice AS o_custkey FROM orders ORDER BY o_custkey + 1, o_orderkey LIMIT 25", "SELECT o_orderkey, 0 - o_totalprice AS o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_define("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
_define("source_order_limit", "SELECT l_orderkey, l_linenumber FROM lineitem LIMIT 7 OFFSET 3", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 7 OFFSET 3")
_define("reversed_source", "SELECT o_orderkey FROM orders LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5", reverse=True)
_define("position_limited", "SELECT POSITION() AS place, o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 10 OFFSET 5", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place, o_orderkey FROM orders ORDER BY place LIMIT 10 OFFSET 5")
_define("position_all", "SELECT POSITION() AS place, o_orderkey FROM orders ORDER BY o_totalprice", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS place, o_orderkey FROM orders")
_define("position_after_distinct", "SELECT DISTINCT POSITION() AS place, o_orderpriority FROM orders ORDER BY o_orderpriority DESC", "SELECT CAST(row_number() OVER (ORDER BY o_orderpriority DESC) AS BIGINT) AS place, o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders)")
# Distinct
_define("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_define("distinct_by_unselected", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_acctbal DESC LIMIT 3", "SELECT c_mktsegment FROM (SELECT c_mktsegment, max(c_acctbal) AS b FROM customer GROUP BY 1) ORDER BY b DESC LIMIT 3")
_define("distinct_groups", "SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC", "SELECT DISTINCT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
# Aggregates
_define("global_aggregate", "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS k, MIN(o_totalprice) AS lo, MAX(o_orderpriority) AS hi, SUM(o_custkey) AS s, AVG(o_totalprice) AS a FROM orders", "SELECT count(*) AS n, count(o_orderkey) AS k, min(o_totalprice) AS lo, max(o_orderpriority) AS hi, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 2) AS a FROM orders", ("a",))
_define("aggregate_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_totalprice < 0", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_totalprice < 0")
_define("group_by_expression", "SELECT o_custkey % 10 AS k, COUNT(*) AS n, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey % 10", "SELECT CAST(o_custkey % 10 AS BIGINT) AS k, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1", ("t",))
_define("group_null_key", f"SELECT status, COUNT(*) AS n, COUNT(priority) AS p FROM {_D} GROUP BY status", f"SELECT status, count(*) AS n, count(priority) AS p FROM {_S} GROUP BY status")
_define("aggregate_filter", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_discount > 0.05) AS n, SUM(l_quantity) FILTER (WHERE l_linestatus = 'O') AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS q FROM lineitem GROUP BY l_returnflag")
_define("having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15 AND MAX(o_totalprice) > 200000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 200000")
_define("having_distinct_from", f"SELECT priority, MAX(status) AS m FROM {_D} GROUP BY priority HAVING MAX(status) IS DISTINCT FROM 'O' OR priority IS NULL", f"SELECT priority, max(status) AS m FROM {_S} GROUP BY priority HAVING max(status) IS DISTINCT FROM 'O' OR priority IS NULL")
_define("case_over_aggregate", "SELECT o_orderpriority, CONCAT('n', CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'other' END) AS c, COUNT(*) * 2 + 1 AS v FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, 'n' || CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'other' END AS c, count(*) * 2 + 1 AS v FROM orders GROUP BY o_orderpriority")
_define("order_by_aggregate", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, MAX(o_totalprice) LIMIT 10", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, max(o_totalprice) LIMIT 10")
_define("pricing_summary", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, SUM(l_extendedprice * (1 - l_discount)) AS d, AVG(l_discount) AS a, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= 1998-09-02T00:00:00 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d, round(avg(l_discount), 2) AS a, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", ("q", "d", "a"))
# Joins
_define("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
_define("join_two_keys", "SELECT a.l_orderkey, a.l_partkey, b.l_quantity AS q FROM lineitem AS a INNER JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 45", "SELECT a.l_orderkey, a.l_partkey, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 45")
_define("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_define("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
_define("join_semi", "SELECT c.c_custkey FROM customer AS c SEMI JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
_define("join_anti", "SELECT c.c_custkey FROM customer AS c ANTI JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')")
_define("join_unequal", "SELECT a.n_name AS x, b.r_name AS y FROM nation AS a JOIN region AS b ON a.n_regionkey < b.r_regionkey OR a.n_nationkey > b.r_regionkey + 20", "SELECT n_name AS x, r_name AS y FROM nation JOIN region ON n_regionkey < r_regionkey OR n_nationkey > r_regionkey + 20")
_define("join_left_unequal", "SELECT a.r_name AS x, b.n_name AS y FROM region AS a LEFT JOIN nation AS b ON a.r_regionkey > b.n_nationkey", "SELECT r_name AS x, n_name AS y FROM region LEFT JOIN nation ON r_regionkey > n_nationkey")
_define("join_anti_null_key", f"SELECT d.o_orderkey FROM {_D} ANTI JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('O', 'F')) AS x ON d.status = x.s", f"SELECT o_orderkey FROM {_S} WHERE status IS NULL OR status NOT IN ('O', 'F')")
_define("join_group", "SELECT n.n_name, COUNT(*) AS k, SUM(c.c_acctbal) AS s FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n_name, count(*) AS k, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", ("s",))
_define("join_derived", "SELECT c.c_name, t.n FROM customer AS c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t ON c.c_custkey = t.o_custkey WHERE t.n > 12", "SELECT c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE n > 12")
_define("join_cte_itself", "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey AS x, b.o_custkey AS y FROM t AS a JOIN t AS b ON a.n = b.n AND a.o_custkey < b.o_custkey WHERE a.n > 17", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT a.o_custkey AS x, b.o_custkey AS y FROM t a JOIN t b ON a.n = b.n AND a.o_custkey < b.o_custkey WHERE a.n > 17")
# Set operations and composition
_define("union_all", "SELECT c_name AS name, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal FROM supplier", "SELECT c_name AS name, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal FROM supplier")
_define("union_unique", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_define("union_chain", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation", "(SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT n_nationkey FROM nation")
_define("union_branch_limit", "(SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC LIMIT 5) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 5) ORDER BY k DESC LIMIT 8", "SELECT k FROM ((SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC LIMIT 5) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 5)) ORDER BY k DESC LIMIT 8")
_define("union_numbers", "SELECT c_custkey AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier", "SELECT CAST(c_custkey AS DOUBLE) AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier")
_define("facets", "SELECT DISTINCT user_id, event_type FROM events OF click, purchase WHERE value > 10", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value > 10")
_define("facet_groups", "SELECT event_type, COUNT(*) AS n FROM events OF view, error, signup GROUP BY event_type ORDER BY n DESC", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'error', 'signup') GROUP BY 1")
_define("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) GROUP BY n")
_define("cte_union_aggregate", "WITH p AS (SELECT c_acctbal AS b, 'c' AS t FROM customer UNION ALL SELECT s_acctbal, 's' FROM supplier) SELECT t, COUNT(*) AS n, MAX(b) AS m FROM p GROUP BY t", "SELECT t, count(*) AS n, max(b) AS m FROM (SELECT c_acctbal AS b, 'c' AS t FROM customer UNION ALL SELECT s_acctbal, 's' FROM supplier) GROUP BY t")
# Collections and structures
_define("collection_any_all", "SELECT vec_id FROM embeddings WHERE ANY(embedding AS e WHERE e > 0.3) AND ALL(embedding AS e WHERE e < 0.45)", "SELECT vec_id FROM embeddings WHERE list_bool_or([CAST(e AS DOUBLE) > 0.3 FOR e IN embedding]) AND list_bool_and([CAST(e AS DOUBLE) < 0.45 FOR e IN embedding])")
_define("collection_count", "SELECT vec_id, COUNT(embedding AS e WHERE e > 0.1) AS n, CARDINALITY(embedding) AS c FROM embeddings", "SELECT vec_id, CAST(len([e FOR e IN embedding IF CAST(e AS DOUBLE) > 0.1]) AS BIGINT) AS n, CAST(len(embedding) AS BIGINT) AS c FROM embeddings")
_define("collection_index", "SELECT vec_id, embedding[0] + 0 AS first, embedding[1000] AS missing FROM embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(NULL AS FLOAT) AS missing FROM embeddings")
_define("collection_filter_map", "SELECT vec_id, CARDINALITY(FILTER(MAP(FILTER(embedding AS e WHERE e > 0) AS x SELECT x * 2) AS y WHERE y > 0.4)) AS n FROM embeddings", "SELECT vec_id, CAST(len([e FOR e IN embedding IF CAST(e AS DOUBLE) * 2 > 0.4]) AS BIGINT) AS n FROM embeddings")
_define("collection_outer_names", "SELECT vec_id FROM embeddings WHERE ANY(embedding AS e WHERE e * 100 > label + 30)", "SELECT vec_id FROM embeddings WHERE list_bool_or([CAST(e AS DOUBLE) * 100 > label + 30 FOR e IN embedding])")
# Random
_define("seeded_random", "SELECT id, RANDOM(7) AS r FROM (SELECT doc_id AS id FROM documents) AS d", "SELECT doc_id AS id, CAST(CAST('0x' || substr(sha256('7' || chr(31) || 'id=' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS r FROM documents")


def _query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@_query("predicate_only_default_id", "SELECT doc_id AS id FROM documents WHERE lang = 'en'")
def _predicate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return sql("lang = 'en'", Catalog().register("documents", documents, ["id"], kinds={"id": "integer"}))


@_query("typed_media_literals", "SELECT id FROM media_metadata WHERE duration_seconds BETWEEN 5400 AND 7200 OR duration_seconds < 90 OR duration_seconds = 3661")
def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = read_table(spark, sf_dir, "media_metadata").withColumnRenamed("duration_seconds", "duration")
    return sql("SELECT id FROM media WHERE duration BETWEEN 1h30m AND 2:00:00 OR duration < 90 s OR duration = '1 hour 1 minute 1 s'", Catalog().register("media", media))


@_query("count_and_date_literals", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def _counts_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.ceil("o_totalprice").alias("view_count"), F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"))
    return sql("SELECT o_orderkey FROM orders WHERE views >= 150k AND date BETWEEN 1 March 1995 AND '29/02/1996'", Catalog().register("orders", orders, ["o_orderkey"]))


@_query("structure_members", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) >= 90")
def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return sql("SELECT event_id, props.k AS k FROM events WHERE props.k >= 90", Catalog().register("events", events, ["event_id"]))


@_query("bound_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'P'")
def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", table_catalog(spark, sf_dir), {"least": 1000, "status": "P"})


@_query("merged_shortcuts", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_totalprice DESC LIMIT 9")
def _shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", table_catalog(spark, sf_dir), filter="o_totalprice > 1000", sort="o_totalprice", descending=True, limit=9)


@_query("archive_exclusion", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return exchange.without_archived(documents, documents.filter("lang = 'de'").select(F.col("doc_id").cast("string").alias("id")), "doc_id").select("doc_id")


@_query("append_unseen", "SELECT DISTINCT video_id AS id FROM documents WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT id FROM media_metadata)")
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read_table(spark, sf_dir, "media_metadata").select("id")
    return exchange.unseen_ids(read_table(spark, sf_dir, "documents").select(F.col("video_id").alias("id")), seen)


@_query("fresh_records", "SELECT field_name, provider_key, count(*) AS n FROM (SELECT o.*, c.max_age_seconds FROM field_observations o JOIN field_provider_candidates c USING (field_name, provider_key)) WHERE max_age_seconds IS NULL OR epoch(observed_at) >= epoch(TIMESTAMP '2025-02-01') - max_age_seconds GROUP BY 1, 2")
def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "field_observations").join(F.broadcast(read_table(spark, sf_dir, "field_provider_candidates").select("field_name", "provider_key", "max_age_seconds")), ["field_name", "provider_key"])
    return exchange.fresh(rows, "observed_at", "max_age_seconds", datetime(2025, 2, 1, tzinfo=timezone.utc)).groupBy("field_name", "provider_key").agg(F.count(F.lit(1)).alias("n"))


@_query("point_lookup", "SELECT id, title, duration_seconds, extractor FROM media_metadata WHERE id IN (SELECT video_id FROM documents WHERE source = 'titles')")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read_table(spark, sf_dir, "documents").filter("source = 'titles'").select(F.col("video_id").alias("id"))
    return exchange.lookup(read_table(spark, sf_dir, "media_metadata"), ids, "id")


@_query("consistent_values", "SELECT id, CASE WHEN count(DISTINCT nullif(extractor, '')) = 1 THEN max(nullif(extractor, '')) END AS extractor FROM media_metadata GROUP BY id")
def _consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.consistent_values(read_table(spark, sf_dir, "media_metadata"), ["id"], ["extractor"])


@_query("json_lines", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"none\":null}' AS value FROM region")
def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.as_json_lines(read_table(spark, sf_dir, "region").withColumn("none", F.lit(None).cast("string")))


@_query("caseless_labels", "SELECT video_id FROM metadata_records WHERE lower(CASE WHEN json_valid(raw_json) THEN json_extract_string(raw_json, '$.availability') END) IN ('unlisted', 'private')")
def _caseless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerated fields compare with a literal in any case."""
    rows = read_table(spark, sf_dir, "metadata_records").select("video_id", F.get_json_object("raw_json", "$.availability").alias("availability"))
    return sql("SELECT video_id FROM m WHERE availability = 'UNLISTED' OR availability IN ('Private')", Catalog().register("m", rows))


@_query("bare_booleans", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE (l_returnflag = 'R') AND NOT coalesce(l_discount > 0.05, false)")
def _booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_discount") > 0.05).alias("reduced"))
    return sql("SELECT l_orderkey, l_linenumber FROM l WHERE returned AND NOT reduced", Catalog().register("l", rows, ["l_orderkey", "l_linenumber"]))


@_query("sink_lines", "SELECT coalesce(text, '') AS value FROM documents")
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.as_lines(sql("SELECT text FROM documents", table_catalog(spark, sf_dir)))


@_query("sink_csv", "SELECT o_orderkey || ',' || o_orderstatus || ',' || chr(34) || o_orderpriority || ', ' || chr(34) || chr(34) || o_custkey || chr(34) || chr(34) || chr(34) || ',' AS value FROM orders")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.as_separated(sql("""SELECT o_orderkey, o_orderstatus, CONCAT(o_orderpriority, ', "', k, '"') AS p, NULLIF(1, 1) AS nothing FROM o""", Catalog().register("o", read_table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey").cast("string")), ["o_orderkey"])), ",")


@_query("sink_tsv", "SELECT event_id || chr(9) || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('us', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || chr(9) || event_type AS value FROM events")
def _tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text; a time that names no zone gets none."""
    return exchange.as_separated(read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type"), "\t")


@_query("sink_ids", "SELECT id AS value FROM media_metadata")
def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.as_references(sql("SELECT id FROM media_metadata", table_catalog(spark, sf_dir)), "ids")


@_query("sink_urls", "SELECT 'https://tube.example/watch?v=' || id AS value FROM media_metadata")
def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.as_references(sql("SELECT id FROM media_metadata", table_catalog(spark, sf_dir)), "urls", "https://tube.example/watch?v=")


@_query("sink_auto", """SELECT CAST(to_json({'r_name': r_name, 'r_regionkey': CAST(r_regionkey AS BIGINT)}) AS VARCHAR) AS value FROM region""")
def _auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.as_text(sql("SELECT * FROM region", table_catalog(spark, sf_dir)))


@_query("schema_listing", "SELECT * FROM (VALUES ('r_name', 'string', true), ('r_regionkey', 'int', true)) t(field, type, nullable)")
def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(exchange.schema_listing(read_table(spark, sf_dir, "region")), "field string, type string, nullable boolean")


@_query("archive_ids", "SELECT video_id AS id FROM documents WHERE video_id IS NOT NULL AND NOT starts_with(source, '#')")
def _archive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an archive, some of them comments or empty; the id is the last word."""
    lines = read_table(spark, sf_dir, "documents").select(F.when(F.col("video_id").isNull(), F.lit(None)).when(F.col("source").startswith("#"), F.concat(F.lit("# "), "video_id")).when(F.col("source").isNotNull(), F.concat(F.lit(" extractor\t"), "video_id", F.lit(" "))).alias("value"))
    return exchange.archived_words(lines)


@_query("bounded_enumeration", """WITH e AS (SELECT DISTINCT source_url, source_index, observed_at FROM source_entries WHERE snapshot_no = 1 AND source_index IS NOT NULL),
f AS (SELECT source_url, source_index, max(observed_at) AS observed_at FROM e GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY source_index) AS place, coalesce(observed_at < TIMESTAMP '2025-01-10 00:00:00', false) AS old FROM f),
h AS (SELECT *, old AND coalesce(lag(old, 1) OVER w, false) AND coalesce(lag(old, 2) OVER w, false) AS ends FROM g WINDOW w AS (PARTITION BY source_url ORDER BY place)),
s AS (SELECT source_url, min(place) AS stop FROM h WHERE ends GROUP BY 1)
SELECT source_url, source_index, place FROM g LEFT JOIN s USING (source_url) WHERE stop IS NULL OR place <= stop""")
def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing read from its start until three consecutive rows are too old."""
    listed = read_table(spark, sf_dir, "source_entries").filter((F.col("snapshot_no") == 1) & F.col("source_index").isNotNull()).groupBy("source_url", "source_index").agg(F.max("observed_at").alias("observed_at"))
    placed = numbered_within(listed, "source_url", ["source_index"], "place")
    return too_old(placed, "source_url", "place", "observed_at", datetime(2025, 1, 10), 0, 3).select("source_url", "source_index", "place")


@_query("known_overlap", """WITH e AS (SELECT snapshot_no, source_url, source_index, max(video_id) AS video_id FROM source_entries WHERE source_index IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT source_url, video_id FROM e WHERE snapshot_no = 1),
g AS (SELECT e.*, row_number() OVER (PARTITION BY e.source_url ORDER BY source_index) AS place, k.video_id IS NOT NULL AS known FROM e LEFT JOIN k ON k.source_url = e.source_url AND k.video_id = e.video_id WHERE snapshot_no = 2),
h AS (SELECT *, known AND coalesce(lag(known) OVER (PARTITION BY source_url ORDER BY place), false) AS ends FROM g),
s AS (SELECT source_url, min(place) AS stop FROM h WHERE ends GROUP BY 1)
SELECT source_url, video_id, place FROM g LEFT JOIN s USING (source_url) WHERE NOT known AND (stop IS NULL OR place <= stop)""")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of the second listing, read until two consecutive ids of the same source are known."""
    listed = read_table(spark, sf_dir, "source_entries").filter(F.col("source_index").isNotNull()).groupBy("snapshot_no", "source_url", "source_index").agg(F.max("video_id").alias("video_id"))
    second = numbered_within(listed.filter("snapshot_no = 2"), "source_url", ["source_index"], "place")
    return unknown_rows(second, listed.filter("snapshot_no = 1"), "source_url", "place", "video_id", 2, same_source=True).select("source_url", "video_id", "place")


@_query("source_coverage", """WITH e AS (SELECT source_url, snapshot_no, count(DISTINCT video_id) AS listed FROM source_entries GROUP BY 1, 2),
o AS (SELECT source_url, snapshot_no, max(observed_entries) AS declared, max(last_observed_at) AS verified_at FROM source_observations GROUP BY 1, 2),
p AS (SELECT DISTINCT source_url, snapshot_no, video_id FROM source_entries),
v AS (SELECT b.source_url, b.snapshot_no, count(*) AS overlap FROM p b JOIN p a ON a.source_url = b.source_url AND a.snapshot_no = b.snapshot_no - 1 AND a.video_id = b.video_id GROUP BY 1, 2)
SELECT o.source_url, o.snapshot_no, coalesce(listed, 0) AS listed, declared, coalesce(overlap, 0) AS overlap, CAST(floor(epoch(verified_at)) AS BIGINT) AS verified_at,
  CASE WHEN declared IS NULL THEN 'unknown' WHEN coalesce(listed, 0) >= declared THEN 'complete' WHEN coalesce(listed, 0) = 0 THEN 'missing' ELSE 'partial' END AS coverage
FROM o LEFT JOIN e USING (source_url, snapshot_no) LEFT JOIN v USING (source_url, snapshot_no)""")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(read_table(spark, sf_dir, "source_entries"), read_table(spark, sf_dir, "source_observations"), "source_url", "snapshot_no", "video_id", "observed_entries", "last_observed_at").withColumn("verified_at", F.unix_seconds("verified_at"))


@_query("source_frontier", "SELECT source_url, count(DISTINCT video_id) AS known_entries, arg_min(video_id, (source_index, video_id)) FILTER (WHERE source_index IS NOT NULL) AS head_id, CAST(floor(epoch(max(observed_at))) AS BIGINT) AS verified_at FROM source_entries WHERE snapshot_no = 4 GROUP BY 1")
def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier(read_table(spark, sf_dir, "source_entries").filter("snapshot_no = 4"), "source_url", "source_index", "video_id", "observed_at").withColumn("verified_at", F.unix_seconds("verified_at"))


@_query("collection_document", """SELECT -1 AS place, '{"schema":"media-collection","version":1,"collection":{"type":"playlist","metadata":{"title":"all media"}},"entries":[' AS value
UNION ALL SELECT row_number() OVER (ORDER BY id, title NULLS FIRST, extractor NULLS FIRST) - 1, CASE WHEN row_number() OVER (ORDER BY id, title NULLS FIRST, extractor NULLS FIRST) = 1 THEN '' ELSE ',' END || '{"target":' || to_json(id) || ',"metadata":{' ||
  concat_ws(',', '"title":' || to_json(title), '"extractor":' || to_json(extractor)) || '}}' FROM media_metadata
UNION ALL SELECT count(*), ']}' FROM media_metadata""")
def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All media as one document, line by line; a row without an id ends the run, as a collection cannot hold it."""
    rows = read_table(spark, sf_dir, "media_metadata").select("id", "title", "extractor")
    return exchange.collection_lines(rows, "id", ["title", "extractor"], {"title": "all media"}, ["id", "title", "extractor"])


@_query("source_references", """SELECT source_url, CASE WHEN NOT regexp_matches(source_url, '^https://tube.example/') THEN 'url' WHEN regexp_matches(source_url, '[?&]list=') THEN 'playlist' ELSE 'channel' END AS kind FROM (SELECT DISTINCT source_url FROM source_observations)""")
def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read_table(spark, sf_dir, "source_observations").select("source_url").distinct()
    return sources.select("source_url", classify(F.col("source_url"), hosts=("tube.example",))["kind"].alias("kind"))


@_query("cached_records", """WITH r AS (SELECT CAST(raw_json AS JSON) AS j, TRY_CAST(CASE WHEN regexp_matches(fetched_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN fetched_at ELSE fetched_at || '+00:00' END AS TIMESTAMPTZ) AS fetched, record_id FROM metadata_records WHERE json_valid(raw_json)),
o AS (SELECT *, j->>'id' AS id FROM r WHERE json_type(j) = 'OBJECT' AND j->>'id' IS NOT NULL),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched DESC NULLS LAST, record_id DESC) = 1),
a AS (SELECT id, j->>'title' AS title, j->'tags' AS tags, TRY_CAST(j->>'duration' AS DOUBLE) AS duration, CASE WHEN json_type(j, '$.formats') = 'ARRAY' THEN CAST(j->'formats' AS JSON[]) END AS formats FROM l)
SELECT id, title, CASE WHEN json_type(tags) = 'ARRAY' THEN CAST(json_array_length(tags) AS BIGINT) END AS n, CAST(len([f FOR f IN formats IF TRY_CAST(f->>'height' AS BIGINT) >= 1080]) AS BIGINT) AS large FROM a
WHERE list_bool_or([f->>'ext' = 'mp4' AND TRY_CAST(f->>'height' AS BIGINT) > 720 FOR f IN formats]) OR duration > 86400""")
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of the cache, queried in place."""
    media = media_records(read_table(spark, sf_dir, "metadata_records"), order=["record_id"])
    return sql("SELECT id, title, CARDINALITY(tags) AS n, COUNT(formats AS f WHERE f.height >= 1080) AS large FROM media WHERE ANY(formats AS f WHERE f.ext = 'mp4' AND f.height > 720) OR duration > 1 day", Catalog().register("media", media))
