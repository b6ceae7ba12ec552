"""SQL through the read-only gate. One text serves both engines where the dialects agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inequality import inequality_aggregate, inequality_aggregate_of_two, interval_join
from ..operators.joins import asof_join, positional_join, range_join
from ..plans.gate import run_sql
from ..operators.quantiles import exact_quantiles
from .tables import numbered, table, views

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

# name: SQL for both, or (for Spark, for DuckDB).
PAIRS: dict[str, str | tuple[str, str]] = {
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_semi": "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey",
    "join_anti": "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'",
    "join_using": "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)",
    "join_natural": "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)",
    "join_theta": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_hint_merge": ("SELECT /*+ MERGE(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_hint_hash": ("SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_group": f"SELECT c_mktsegment, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "subquery_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "subquery_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)",
    "subquery_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "subquery_scalar": "SELECT p_partkey FROM part WHERE p_size > (SELECT avg(p_size) FROM part)",
    "subquery_lateral": "SELECT n_nationkey, x.m FROM nation, LATERAL (SELECT max(s_suppkey) AS m FROM supplier WHERE s_nationkey = n_nationkey) x",
    "join_asof_text": "SELECT b.event_id, v.event_id AS seen_id, v.value FROM events b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts > v.ts WHERE b.event_type = 'purchase'",
    "join_asof_next": "SELECT a.event_id, n.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF JOIN (SELECT event_id, user_id AS who, ts AS at_ts FROM events WHERE event_type = 'purchase') n ON who = a.user_id AND at_ts >= a.ts",
    "join_positional_text": "SELECT n_name, r_name FROM (SELECT * FROM nation ORDER BY n_nationkey) n POSITIONAL JOIN (SELECT r_name FROM region ORDER BY r_regionkey DESC) r",
    "agg_group": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_extendedprice')} AS price, round(avg(l_quantity), 4) AS avg_quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "agg_min_max": "SELECT event_type, min(ts) AS first_ts, max(value) AS max_value FROM events GROUP BY event_type",
    "agg_filter": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",
    "agg_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "agg_quantile": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q, round(median(value), 6) AS m FROM events GROUP BY event_type",
    "agg_mode": ("SELECT o_orderstatus, mode(o_orderpriority, true) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, o_orderpriority AS m FROM (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_orderstatus, o_orderpriority) WHERE r = 1"),
    "agg_max_by": "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS last_name, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
    "agg_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_list": ("SELECT n_regionkey, array_join(array_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey"),
    "pivot": ("PIVOT orders ON o_orderstatus USING count(*) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority"),
    "pivot_two_columns": "PIVOT orders ON o_orderstatus, o_orderpriority USING count(*) AS n, max(o_custkey) AS k GROUP BY o_orderdate",
    "pivot_in": "PIVOT orders ON o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority",
    "pivot_rest": "PIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem) ON l_returnflag USING sum(l_quantity)",
    "pivot_clause": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o FROM orders GROUP BY 1"),
    "unpivot": "UNPIVOT (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation, s_suppkey * 2 AS twice FROM supplier) ON nation, twice INTO NAME what VALUE amount",
    "win_rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST) AS BIGINT) AS r FROM part",
    "win_dense_rank": "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST) AS BIGINT) AS r FROM part",
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS r FROM orders",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q FROM customer",
    "win_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS p FROM supplier",
    "win_cume_dist": "SELECT s_suppkey, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS p FROM supplier",
    "win_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "win_first_last_nth": "SELECT event_id, first_value(value) OVER w AS a, last_value(value) OVER w AS b, nth_value(value, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "win_rows_frame": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM orders",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "win_ignore_nulls": ("SELECT event_id, last_value(CASE WHEN value > 20 THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events", "SELECT event_id, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events"),
    "win_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "win_groups_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part",
    "win_exclude_current": "SELECT p_partkey, CAST(coalesce(sum(p_size) OVER (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS BIGINT) AS s FROM part",
    "win_exclude_group": "SELECT x.p_partkey, max(x.p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP) AS m, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE TIES) AS n, min(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS k FROM part x WHERE p_size > 3",
    "sort_nulls": "SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS k FROM customer ORDER BY k NULLS LAST, c_custkey LIMIT 40",
    "order_by_all": "SELECT n_regionkey, n_name FROM nation ORDER BY ALL",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "set_intersect": "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "set_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT c_name, n FROM top JOIN customer ON o_custkey = c_custkey",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "from_first": "FROM nation",
    "select_exclude": "SELECT * EXCLUDE (n_nationkey) FROM nation",
    "fn_string": "SELECT o_orderkey, upper(o_orderpriority) AS u, lower(o_orderpriority) AS l, substr(o_orderpriority, 3) AS s, CAST(length(o_orderpriority) AS BIGINT) AS n, replace(o_orderpriority, '-', '_') AS r, trim(concat(' ', o_orderstatus)) AS t FROM orders",
    "fn_date": ("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, year(o_orderdate) AS y, strftime(o_orderdate, '%Y/%m') AS f FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y/%m') AS f FROM orders"),
    "fn_math": ("SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, round(sqrt(p_size), 6) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, try_divide(p_size, p_size - p_size) AS z FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, round(sqrt(p_size), 6) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(NULL AS DOUBLE) AS z FROM part"),
    "fn_list": ("SELECT n_nationkey, list_contains([1, 2, 3], n_regionkey) AS c, array_join(transform([1, 2], x -> x + n_nationkey), ',') AS t FROM nation", "SELECT n_nationkey, list_contains([1, 2, 3], n_regionkey) AS c, array_to_string(list_transform([1, 2], lambda x: x + n_nationkey), ',') AS t FROM nation"),
    "fn_unnest": "SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS x FROM nation",
    "fn_map": ("SELECT n_nationkey, map('a', n_name)['a'] AS a, named_struct('k', n_regionkey).k AS k FROM nation", "SELECT n_nationkey, MAP {'a': n_name}['a'] AS a, {'k': n_regionkey}.k AS k FROM nation"),
    "fn_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "fn_regexp": "SELECT p_partkey, regexp_matches(p_type, '^S.*L$') AS m FROM part",
    "fn_cast": "SELECT o_orderkey, o_orderkey::VARCHAR AS s, CAST('12' AS INTEGER) AS i, TRY_CAST('x' AS INTEGER) AS n FROM orders",
    "fn_coalesce": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer",
    "fn_regexp_pattern_first": ("SELECT p_partkey FROM part WHERE regexp('^S.*L$', p_type)", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^S.*L$')"),
    "fn_lambda": ("SELECT n_nationkey, array_join(list_transform(list_filter([1, 2, 3, n_nationkey], lambda x: x > 1), lambda x: x * 2), ',') AS s FROM nation", "SELECT n_nationkey, array_to_string(list_transform(list_filter([1, 2, 3, n_nationkey], lambda x: x > 1), lambda x: x * 2), ',') AS s FROM nation"),
    "select_columns": ("SELECT COLUMNS('^n_.*key$'), upper(n_name) AS u FROM nation WHERE n_regionkey > 0", "SELECT n_nationkey, n_regionkey, upper(n_name) AS u FROM nation WHERE n_regionkey > 0"),
    "unpivot_in_brackets": "UNPIVOT (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation, s_suppkey * 2 AS twice FROM supplier WHERE s_suppkey IN (2, 4, 7)) ON nation, twice INTO NAME what VALUE amount",
    "fn_levenshtein": "SELECT n_name, CAST(levenshtein(n_name, 'NATION_1') AS BIGINT) AS d FROM nation",
    "fn_like": "SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR p_brand ILIKE 'BRAND#1_'",
    "fn_range": ("SELECT id AS i FROM range(3, 9)", "SELECT range AS i FROM range(3, 9)"),
    "fn_generate_series": ("SELECT id AS i FROM generate_series(3, 9)", "SELECT generate_series AS i FROM generate_series(3, 9)"),
}


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return run_sql(spark, text)

    return run


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views_ = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("seen_id"))
    return asof_join(buys, views_, by=["user_id"], left_on="ts", right_on="seen", take=["seen_id"]).select("event_id", "seen_id")


def _positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = numbered(table(spark, sf_dir, "nation"), "n_nationkey"), numbered(table(spark, sf_dir, "region"), "r_regionkey")
    return positional_join(a, b).select("n_name", "r_name")


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 17 + 900).cast("double").alias("lo"), (F.col("s_suppkey") * 17 + 930 + F.pmod(F.col("s_suppkey"), F.lit(5)) * 100).cast("double").alias("hi"))
    return range_join(sizes, bands, point="p_retailprice", start="lo", end="hi", width=7.0).select("p_partkey", "s_suppkey")


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, open for value hours, and errors of the same or another user, open for an hour."""
    events = table(spark, sf_dir, "events")
    span = lambda kind, names, hours: events.filter(F.col("event_type") == kind).select(F.col("event_id").alias(names[0]), F.col("user_id").alias(names[1]), F.col("ts").alias(names[2]), F.expr(f"ts + make_interval(0, 0, 0, 0, {hours})").alias(names[3]))
    a = span("purchase", ("buy_id", "buyer", "a_from", "a_to"), "CAST(floor(value) AS INT)")
    b = span("error", ("error_id", "user_id", "b_from", "b_to"), "1")
    return interval_join(a, b, left_on=("a_from", "a_to"), right_on=("b_from", "b_to")).select("buy_id", "error_id", (F.col("buyer") == F.col("user_id")).alias("same"))


def _self_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with each other, by user: those of two days that overlap."""
    events = table(spark, sf_dir, "events")
    side = lambda x: events.select(F.col("event_id").alias(f"{x}_id"), F.col("user_id").alias(f"{x}_user"), F.col("ts").alias(f"{x}_from"), F.expr("ts + INTERVAL 2 DAYS").alias(f"{x}_to"))
    met = interval_join(side("a"), side("b"), left_on=("a_from", "a_to"), right_on=("b_from", "b_to"), by=[("a_user", "b_user")])
    return met.groupBy("a_id").agg(F.count("*").alias("n"), F.max("b_id").alias("last"))


def _inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, and the lines of any order that cost more than the whole order."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), table(spark, sf_dir, "lineitem")
    return inequality_aggregate(orders, lines, on=("o_totalprice", "<", "l_extendedprice"), aggs={"n": ("count", "*"), "quantity": ("sum", "l_quantity"), "first_day": ("min", "l_shipdate"), "discount": ("max", "l_discount")}).drop("o_totalprice")


def _inequality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by two conditions of order, summed up by order without being made."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", (F.col("o_totalprice") + 90000).alias("price"))
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_shipdate", "l_quantity")
    met = inequality_aggregate_of_two(orders, lines, on=[("price", "<", "l_extendedprice"), ("o_orderdate", ">=", "l_shipdate")], aggs={"n": ("count", "*"), "quantity": ("sum", "l_quantity")})
    return met.groupBy("o_orderkey", "o_orderpriority").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of prices by order of a line, no group being held in one task."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_extendedprice", {"q1": 0.25, "m": 0.5, "q99": 0.99})
    return found.select("l_linenumber", *[F.round(c, 6).alias(c) for c in ("q1", "m", "q99")])


def _quantile_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantiles(table(spark, sf_dir, "events"), [], "value", {"m": 0.5, "low": 0.0, "high": 1.0})


def _approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimates are within a tenth of the exact numbers (their standard error is a twentieth)."""
    return _sql("SELECT o_orderstatus, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus")(spark, sf_dir)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many rows as asked for, none twice, all from the table; or about the share asked for."""
    some = _sql("SELECT o_orderkey, o_custkey FROM orders USING SAMPLE 40 ROWS")(spark, sf_dir)
    real = some.join(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], "left_semi")
    share = _sql("SELECT CAST(count(*) AS DOUBLE) AS n FROM orders USING SAMPLE 20%")(spark, sf_dir)
    total = table(spark, sf_dir, "orders").agg(F.count("*").alias("total"))
    whole = real.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys"))
    return whole.crossJoin(share).crossJoin(total).select("rows", "keys", (F.abs(F.col("n") / F.col("total") - 0.2) < 0.1).alias("near"))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is put on the result, whatever the text says."""
    views(spark, sf_dir)
    return run_sql(spark, "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500) ORDER BY o_orderkey", 100)


QUERIES = {name: _sql(pair if isinstance(pair, str) else pair[0]) for name, pair in PAIRS.items()} | {
    "join_asof": _asof,
    "join_positional": _positional,
    "join_range": _range,
    "join_interval": _interval,
    "join_interval_self": _self_interval,
    "join_inequality": _inequality,
    "agg_quantile_exact": _quantiles,
    "agg_quantile_of_all": _quantile_of_all,
    "join_inequality_pairs": _inequality_pairs,
    "agg_approx_distinct": _approx,
    "using_sample": _sample,
    "limit_injection": _limited,
}
ORACLE_SQL = {
    "agg_quantile_exact": "SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS m, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY l_linenumber",
    "agg_quantile_of_all": "SELECT median(value) AS m, min(value) AS low, max(value) AS high FROM events",
} | {name: pair if isinstance(pair, str) else pair[1] for name, pair in PAIRS.items()} | {
    "join_asof": "SELECT b.event_id, v.event_id AS seen_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts",
    "join_positional": "SELECT n_name, r_name FROM (SELECT * FROM nation ORDER BY n_nationkey) POSITIONAL JOIN (SELECT * FROM region ORDER BY r_regionkey)",
    "join_range": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_suppkey * 17 + 900 AND p_retailprice < s_suppkey * 17 + 930 + s_suppkey % 5 * 100",
    "join_interval": "WITH a AS (SELECT event_id AS buy_id, user_id AS buyer, ts AS s, ts + to_hours(CAST(floor(value) AS INTEGER)) AS e FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS error_id, user_id, ts AS s, ts + INTERVAL 1 HOUR AS e FROM events WHERE event_type = 'error') SELECT buy_id, error_id, buyer = user_id AS same FROM a JOIN b ON a.s < b.e AND b.s < a.e AND a.s < a.e",
    "join_interval_self": "SELECT a.event_id AS a_id, count(*) AS n, max(b.event_id) AS last FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts < b.ts + INTERVAL 2 DAY AND b.ts < a.ts + INTERVAL 2 DAY GROUP BY a.event_id",
    "join_inequality": "SELECT o_orderkey, count(l_orderkey) AS n, sum(l_quantity) AS quantity, min(l_shipdate) AS first_day, max(l_discount) AS discount FROM orders LEFT JOIN lineitem ON o_totalprice < l_extendedprice GROUP BY o_orderkey",
    "join_inequality_pairs": "SELECT o_orderkey, o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_totalprice + 90000 < l_extendedprice AND o_orderdate >= l_shipdate GROUP BY o_orderkey, o_orderpriority",
    "agg_approx_distinct": "SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus",
    "using_sample": "SELECT CAST(40 AS BIGINT) AS rows, CAST(40 AS BIGINT) AS keys, true AS near",
    "limit_injection": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100",
}
