"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm, the least of three runs; prints one line of JSON.

Start of the JVM and the first, warming run do not count. Each query's rows are counted before it is timed, and must be as many in every
run, so a query that fails gives no figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from gridsift.model import SearchQuery  # noqa: E402
from gridsift.operators.search import search_table  # noqa: E402
from gridsift.plans.gate import run_sql  # noqa: E402
from gridsift.queries.tables import table, views  # noqa: E402
from gridsift.session import session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

SQL = {
    "c_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "d_join_group": "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "e_topk": "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100",
}


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    views(spark, SF_DIR)
    runs = {
        "a_search_all": lambda: search_table(table(spark, SF_DIR, "orders"), SearchQuery("urgent")),
        "a_search_documents": lambda: search_table(table(spark, SF_DIR, "documents"), SearchQuery("tion")),
        "b_search_one": lambda: search_table(table(spark, SF_DIR, "orders"), SearchQuery("urgent", column="o_orderpriority")),
        "scan_lineitem": lambda: table(spark, SF_DIR, "lineitem").agg(*[F.max(c) for c in ("l_extendedprice", "l_shipdate")]),
    } | {name: (lambda s=sql: run_sql(spark, s)) for name, sql in SQL.items()}
    times = {}
    for name, run in runs.items():
        rows = run().count()
        assert rows > 0, name
        seen = []
        for _ in range(4):
            began = time.perf_counter()
            got = len(run().toArrow())
            seen.append(time.perf_counter() - began)
            assert got == rows, name
        times[name] = round(min(seen[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
