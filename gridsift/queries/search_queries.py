"""Searches, slices, samples and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW, Condition, SearchQuery
from ..operators import profile
from ..operators.search import search, search_stats, search_table, value_counts, with_context
from ..operators.text_index import build_text_index, indexed_search
from ..session import shared_dir
from .tables import numbered, table


def _found(name: str, query: SearchQuery, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_table(table(spark, sf_dir, name), query).select(*columns)

    return run


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_table(table(spark, sf_dir, "documents"), SearchQuery("en"))
    return found.select("doc_id", F.concat_ws(",", "matched_columns").alias("matched"))


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [(f"{n}.parquet", n, numbered(table(spark, sf_dir, n), k, 0)) for n, k in (("nation", "n_nationkey"), ("region", "r_regionkey"))]
    found = search(tables, SearchQuery("_1"))
    return found.select("sheet", "row_index", F.concat_ws(",", "matched_columns").alias("matched"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("turn", ROW).select("conv_id", ROW, "role", "text")
    hits = search_table(turns, SearchQuery("the", column="text", conditions=(Condition("role", "=", "user"),)))
    out = with_context(turns, hits, 1, ["conv_id"])
    roles = lambda side: F.concat_ws(",", F.transform(side, lambda r: r["role"]))
    return out.select("conv_id", F.col(ROW).alias("turn"), roles("before").alias("before"), roles("after").alias("after"))


def _aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(search_table(table(spark, sf_dir, "events"), SearchQuery("c", column="event_type")), "event_type")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_stats([(f"{n}.parquet", n, table(spark, sf_dir, n)) for n in ("nation", "region")], SearchQuery("a")).select("sheet", "rows_searched", "matches")


def _limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's own limit: the first rows in order of row numbers, over two tables."""
    orders, nation = numbered(table(spark, sf_dir, "orders"), "o_orderkey"), numbered(table(spark, sf_dir, "nation"), "n_nationkey")
    found = search([("orders.parquet", "orders", orders), ("nation.parquet", "nation", nation)], SearchQuery("2-HIGH", limit=25), in_order=True)
    return found.select("sheet", "row_index")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by an index made for them, which may leave out files."""
    path, index = f"{sf_dir}/documents.parquet", f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
    build_text_index(spark, path, index)
    found = indexed_search(spark, path, index, SearchQuery("licens"))
    return found.df.select("doc_id", F.concat_ws(",", "matched_columns").alias("matched"), F.lit(found.files_read <= found.files).alias("within"))


def _on_orders(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(numbered(table(spark, sf_dir, "orders"), "o_orderkey", 0))

    return run


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many rows as asked for, none twice, all from the table, and not its first ones."""
    orders = numbered(table(spark, sf_dir, "orders"), "o_orderkey")
    real = profile.sample_random(orders, 50).join(orders, orders.columns, "left_semi")
    return real.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), (F.max(ROW) > 200).alias("spread"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_statistics(table(spark, sf_dir, "orders"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profile.top_values(table(spark, sf_dir, "part").drop("p_retailprice"), 3)
    return top.withColumn("rank", F.col("rank").cast("long"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of customer; the estimated numbers of values are told as near or not."""
    customer = table(spark, sf_dir, "customer")
    exact = profile.column_statistics(customer).select("column_name", F.col("distinct_count").alias("exact"))
    got = profile.summarize(customer).join(exact, "column_name")
    return got.select("column_name", "column_type", "min", "max", "n", "nulls", F.round("avg", 4).alias("avg"), (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.2 * F.col("exact")).alias("near"))


QUERIES = {
    "search_fulltext_all": _found("documents", SearchQuery("tion"), "doc_id"),
    "search_fulltext_column": _found("orders", SearchQuery("medium", column="o_orderpriority"), "o_orderkey", "o_orderpriority"),
    "search_fulltext_literal_percent": _found("documents", SearchQuery("%%", column="text"), "doc_id"),
    "search_exact": _found("orders", SearchQuery("F", column="o_orderstatus", mode="exact"), "o_orderkey"),
    "search_wildcard": _found("part", SearchQuery("%eCONO%", mode="wildcard"), "p_partkey"),
    "search_wildcard_one": _found("part", SearchQuery("brand#_3", column="p_brand", mode="wildcard"), "p_partkey", "p_brand"),
    "search_regex": _found("orders", SearchQuery("^[1-2]-.*", column="o_orderpriority", mode="regex"), "o_orderkey"),
    "search_regex_unicode": _found("documents", SearchQuery("ÉE[AU]+", column="text", mode="regex"), "doc_id"),
    "search_invert": _found("orders", SearchQuery("o", column="o_orderstatus", invert=True), "o_orderkey", "o_orderstatus"),
    "search_invert_conditions": _found("orders", SearchQuery("o", column="o_orderstatus", invert=True, conditions=(Condition("o_orderpriority", "LIKE", "5%"),)), "o_orderkey"),
    "search_conditions_numeric": _found("orders", SearchQuery("", conditions=(Condition("o_custkey", ">", "99"), Condition("o_custkey", "<=", "150"))), "o_orderkey", "o_custkey"),
    "search_conditions_date": _found("orders", SearchQuery("", conditions=(Condition("o_orderdate", ">=", "1996-01-01"), Condition("o_orderdate", "<", "1997"))), "o_orderkey"),
    "search_conditions_ilike": _found("orders", SearchQuery("", conditions=(Condition("o_orderpriority", "ILIKE", "%high"), Condition("o_orderstatus", "<>", "F"))), "o_orderkey"),
    "search_typed_columns": _found("lineitem", SearchQuery("17", column="l_partkey"), "l_orderkey", "l_linenumber", "l_partkey"),
    "search_missing_column": _found("orders", SearchQuery("x", column="no_such"), "o_orderkey"),
    "search_multi_table": _multi,
    "search_matched_columns": _matched,
    "search_context": _context,
    "search_limit_ordered": _limit,
    "search_indexed": _indexed,
    "search_aggregate": _aggregate,
    "search_stats": _stats,
    "slice_rows": _on_orders(lambda d: profile.slice_rows(d, 100, 140, ["o_totalprice", "no_such", "o_orderkey"]).drop(ROW)),
    "project_columns": _on_orders(lambda d: profile.project(d, ["o_orderstatus", "o_orderkey", "missing"])),
    "sample_even": _on_orders(lambda d: profile.sample_evenly(d, 37).select("o_orderkey")),
    "sample_random": _random,
    "column_statistics": _statistics,
    "column_top_values": _top,
    "summarize_table": _summary,
}

ORACLE_SQL = {
    "search_indexed": "SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'licens') THEN 'text' END, CASE WHEN contains(lower(lang), 'licens') THEN 'lang' END, CASE WHEN contains(lower(source), 'licens') THEN 'source' END) AS matched, true AS within FROM documents WHERE contains(lower(text), 'licens') OR contains(lower(lang), 'licens') OR contains(lower(source), 'licens')",
    "search_fulltext_all": "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(lang), 'tion') OR contains(lower(source), 'tion') OR contains(CAST(doc_id AS VARCHAR), 'tion') OR contains(CAST(n_chars AS VARCHAR), 'tion')",
    "search_fulltext_column": "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'medium')",
    "search_fulltext_literal_percent": "SELECT doc_id FROM documents WHERE contains(text, '%%')",
    "search_exact": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "search_wildcard": "SELECT p_partkey FROM part WHERE p_name ILIKE '%eCONO%' OR p_brand ILIKE '%eCONO%' OR p_type ILIKE '%eCONO%'",
    "search_wildcard_one": "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'brand#_3'",
    "search_regex": "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '(?i)^[1-2]-.*')",
    "search_regex_unicode": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)ÉE[AU]+')",
    "search_invert": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT contains(lower(o_orderstatus), 'o')",
    "search_invert_conditions": "SELECT o_orderkey FROM orders WHERE NOT contains(lower(o_orderstatus), 'o') AND o_orderpriority LIKE '5%'",
    "search_conditions_numeric": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 99 AND o_custkey <= 150",
    "search_conditions_date": "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') >= '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') < '1997'",
    "search_conditions_ilike": "SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%high' AND o_orderstatus <> 'F'",
    "search_typed_columns": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE contains(CAST(l_partkey AS VARCHAR), '17')",
    "search_missing_column": "SELECT o_orderkey FROM orders WHERE false",
    "search_multi_table": " UNION ALL ".join(
        f"SELECT '{t}' AS sheet, CAST({key} AS BIGINT) AS row_index, '{name}' AS matched FROM {t} WHERE contains(lower({name}), '_1')"
        for t, key, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))
    ),
    "search_matched_columns": "SELECT doc_id, concat_ws(',', CASE WHEN contains(CAST(doc_id AS VARCHAR), 'en') THEN 'doc_id' END, CASE WHEN contains(lower(text), 'en') THEN 'text' END, CASE WHEN contains(lang, 'en') THEN 'lang' END, CASE WHEN contains(source, 'en') THEN 'source' END) AS matched FROM documents WHERE contains(lower(text), 'en') OR contains(lang, 'en') OR contains(source, 'en')",
    "search_context": """
        SELECT c.conv_id, c.turn,
               coalesce((SELECT string_agg(role, ',' ORDER BY turn) FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 1), '') AS before,
               coalesce((SELECT string_agg(role, ',' ORDER BY turn) FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn + 1), '') AS after
        FROM conversations c WHERE contains(lower(c.text), 'the') AND c.role = 'user'""",
    "search_limit_ordered": "SELECT 'orders' AS sheet, o_orderkey AS row_index FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 25",
    "search_aggregate": "SELECT event_type AS value, count(*) AS n FROM events WHERE contains(lower(event_type), 'c') GROUP BY 1",
    "search_stats": """
        SELECT 'nation' AS sheet, count(*) AS rows_searched, count(*) FILTER (WHERE contains(lower(n_name), 'a')) AS matches FROM nation
        UNION ALL SELECT 'region', count(*), count(*) FILTER (WHERE contains(lower(r_name), 'a')) FROM region""",
    "slice_rows": "SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 140",
    "project_columns": "SELECT o_orderstatus, o_orderkey FROM orders",
    "sample_even": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT i * (SELECT count(*) FROM orders) // 37 FROM range(37) t(i))",
    "sample_random": "SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS keys, true AS spread",
    "column_statistics": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_count FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "column_top_values": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank FROM part GROUP BY {c}) WHERE rank <= 3" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")),
    "summarize_table": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS column_type, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count(*) AS n, count(*) - count({c}) AS nulls, {f'round(avg({c}), 4)' if kind != 'string' else 'CAST(NULL AS DOUBLE)'} AS avg, true AS near FROM customer"
        for c, kind in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))
    ),
}
