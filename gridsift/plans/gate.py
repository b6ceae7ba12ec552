"""Read-only SQL: statements are parsed by Spark, and the parsed plan must hold nothing that changes anything. The analysed plan, in which
all names have been looked up, must rest on registered views and values alone, and call no code."""

from __future__ import annotations

import itertools
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import summarize
from .asof import compiled
from .dialect import rewritten, with_columns
from .tokens import joined, solid, tokens

# Commands that only look.
FIRST = {"SELECT", "WITH", "FROM", "VALUES", "TABLE", "DESCRIBE", "DESC", "SHOW", "EXPLAIN", "("}
# Functions that call any code, and formats whose files SQL could name by path.
CALLING = {"java_method", "reflect", "try_reflect"}
FORMATS = {"parquet", "csv", "json", "orc", "text", "avro", "xml", "binaryfile", "delta", "jdbc", "image", "libsvm"}
LOOKING = {"DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeTableCommand", "ShowTables", "ShowTablesCommand", "ShowColumns", "ShowColumnsCommand", "ShowNamespaces", "ShowFunctions", "ShowViews", "ExplainCommand", "DescribeFunction"}

#: Plan nodes of plain queries, as Spark's parser names them. A plan of these alone needs no closer look.
QUERYING = {"Aggregate", "CTE", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LocalLimit", "Offset", "OneRowRelation", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "WithWindowDefinition"}

# Leaves of analysed plans that read nothing: values, ranges, parts of the statement itself, what a looking command has found.
LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "CommandResult"}
#: Pivoted columns, at most.
MOST_PIVOTED = 10_000

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Raises ValueError for anything but one query, DESCRIBE, SHOW or EXPLAIN, and for queries that call code or read files by path."""
    parts = tokens(sql)
    at = [parts[i] for i in solid(parts)]
    if not at:
        raise ValueError("the SQL is empty")
    if (at[0].word() or at[0].text) not in FIRST:
        raise ValueError(f"only read-only statements are allowed, not {at[0].text}")
    bare = lambda t: t.text[1:-1].lower() if t.kind == "quoted" else t.text.lower()
    for a, b in zip(at, at[1:]):
        if b.text == "(" and a.kind in ("word", "quoted") and bare(a) in CALLING:
            raise ValueError(f"{a.text} is not allowed")
    for a, dot, b in zip(at, at[1:], at[2:]):
        if dot.text == "." and b.kind == "quoted" and a.kind in ("word", "quoted") and bare(a) in FORMATS:
            raise ValueError(f"files by path are not allowed: {a.text}.{b.text}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError(f"not a statement: {str(e).splitlines()[0]}") from e
    # A line for each node; a literal of several lines only adds names that are not known.
    if {m[1] for m in re.finditer(r"(?m)^[\s:+|-]*'?(\w*)", plan.treeString())} <= QUERYING | {""}:
        return
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    changing = [loader.loadClass(f"{_LOGICAL}.{name}") for name in ("Command", "ParsedStatement")]
    is_plan = loader.loadClass(f"{_LOGICAL}.LogicalPlan").isInstance
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "ScriptTransformation" or any(c.isInstance(node) for c in changing) and name not in LOOKING:
            raise ValueError(f"only read-only statements are allowed, not {name}")
        if name == "ExplainCommand":
            nodes.append(node.logicalPlan())
        for group in (node.children(), node.innerChildren()):
            found = [group.apply(i) for i in range(group.size())]
            nodes += [x for x in found if is_plan(x)]


def check_plan(out: DataFrame, sql: str) -> None:
    """Raises ValueError unless the analysed plan of out, which sql has given, reads registered views alone and calls no code by reflection.

    However a relation is named, it is a leaf, and one that no view of the session holds is refused. Reflection needs the name of such a function in the
    statement, or IDENTIFIER(), which makes names of text: only then all expressions are looked through, as whole trees.
    """
    plan = out._jdf.queryExecution().analyzed()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name, children, inner = node.getClass().getSimpleName(), node.children(), node.innerChildren()
        if name == "View":
            if not node.isTempView():
                raise ValueError("only the session's own tables can be read")
            continue
        size = children.size()
        if not size and name not in LEAVES | LOOKING:
            raise ValueError(f"only registered tables can be read, not what {name} names")
        nodes += [children.apply(i) for i in range(size)] + [inner.apply(i) for i in range(inner.size())]
    if re.search(r"(?i)identifier|reflect|java", sql):
        todo = [json.loads(plan.toJSON())]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if "Reflect" in str(x.get("class", "")).rpartition(".")[2]:
                    raise ValueError("functions that call code are not allowed")
                todo += x.values()
            elif isinstance(x, list):
                todo += x


def _pivot(df: DataFrame, on: str, using: str, by: list[str] | None) -> DataFrame:
    """PIVOT: a column for each combination of the values of all of `on` (or of those in its IN lists), named by these values and _; without USING counts; without GROUP BY all other columns."""
    # An item: its text, and the values that it may be limited to.
    keys: list[tuple[str, list[str] | None]] = []
    for item in _items(on):
        parts = tokens(item)
        at = next((i for i, t in enumerate(parts) if t.word() == "IN" and t.depth == 0), len(parts))
        keys.append((joined(parts[:at]).strip(), _items(_inside(joined(parts[at + 1 :]).strip())) if at < len(parts) else None))
    aggs = [rewritten(a) for a in _items(using or "count(*)")]
    columns = [F.expr(rewritten(k)).cast("string") for k, _ in keys]
    if by is None:
        used = {t.text.strip('`"').lower() for t in tokens(f"{on} {using}") if t.kind in ("word", "quoted")}
        by = [c for c in df.columns if c.lower() not in used]
    lists = []
    for column, (_, values) in zip(columns, keys):
        if values is None:
            rows = df.select(column.alias("v")).filter("v IS NOT NULL").distinct().limit(MOST_PIVOTED + 1).collect()
            lists.append(sorted(r.v for r in rows))
        else:
            found = df.sparkSession.range(1).select(*[F.expr(rewritten(v)).cast("string") for v in values]).first()
            lists.append([v for v in found if v is not None])
    names = ["_".join(x) for x in itertools.product(*lists)]
    if len(names) > MOST_PIVOTED:
        raise ValueError(f"PIVOT would make {len(names)} columns; {MOST_PIVOTED} are allowed")
    # Null values have no column. Values are put together with a sign that joins no two lists of values to the same text.
    key = F.when(F.greatest(*[F.lit(0), *[c.isNull().cast("int") for c in columns]]) == 0, F.concat_ws("\x00", *columns))
    out = df.withColumn("_pivoted", key).groupBy(*[F.col(f"`{c}`") for c in by]).pivot("_pivoted", ["\x00".join(x) for x in itertools.product(*lists)]).agg(*[F.expr(a) for a in aggs])
    made = out.columns[len(by) :]
    plain = [(c.replace("\x00", "_"), aggs[i % len(aggs)]) for i, c in enumerate(made)]
    out = out.toDF(*by, *[c for c, _ in plain])
    return out.fillna(0, [c for c, a in plain if re.match(r"(?i)count\s*\(", a)])


def _clauses(text: str, words: tuple[str, ...]) -> dict[str, str]:
    """The text after each of the words, where they stand outside of brackets and in this order; "" is what comes before the first."""
    out, now, begin, parts = {}, "", 0, tokens(text)
    left = list(words)
    for i, t in enumerate(parts):
        if t.depth == 0 and t.word() in left:
            out[now], now, begin = joined(parts[begin:i]).strip(), t.word(), i + 1
            del left[: left.index(now) + 1]
    out[now] = joined(parts[begin:]).strip()
    return out


def _inside(text: str) -> str:
    """A text without the one pair of brackets around all of it."""
    parts = [t for t in tokens(text.strip())]
    return joined(parts[1:-1]) if len(parts) > 1 and parts[0].text == "(" and parts[-1].text == ")" and all(t.depth for t in parts[1:-1]) else text


def _items(text: str) -> list[str]:
    """The parts of a text between commas outside of brackets."""
    out, begin, parts = [], 0, tokens(text)
    for i, t in enumerate(parts):
        if t.text == "," and t.depth == 0:
            out, begin = [*out, joined(parts[begin:i])], i + 1
    return [x.strip() for x in [*out, joined(parts[begin:])]]


def run_sql(spark: SparkSession, sql: str, limit: int | None = None, relations: dict[str, str] | None = None) -> DataFrame:
    """The result of one read-only statement, with its own types; limit as DataFrame.limit, never by changing the text.

    Besides Spark's SQL: SUMMARIZE, the PIVOT and UNPIVOT statements, QUALIFY, FROM first, USING SAMPLE, COLUMNS('pattern'), ASOF and POSITIONAL joins, and what dialect.rewritten() knows.
    """
    text = sql.strip().rstrip(";").strip()
    first, _, after = text.partition(" ") if not re.match(r"\w+\s", text) else (re.match(r"\w+", text)[0], " ", re.sub(r"^\w+\s+", "", text))

    def table(source: str) -> DataFrame:
        inner = _inside(source)
        query = inner if inner is not source or re.match(r"(?i)\s*(SELECT|WITH|FROM|VALUES)\b", inner) else f"SELECT * FROM {source}"
        return run_sql(spark, query, relations=relations)

    bare = lambda names: [n.strip().strip('`"') for n in _items(names)]
    if first.upper() == "SUMMARIZE":
        out = summarize(table(after))
    elif first.upper() == "PIVOT":
        parts = _clauses(after, ("ON", "USING", "GROUP"))
        if not parts.get("ON"):
            raise ValueError("PIVOT needs ON")
        by = re.sub(r"(?i)^BY\s+", "", parts.get("GROUP", ""))
        try:
            out = _pivot(table(parts[""]), parts["ON"], parts.get("USING", ""), bare(by) if by else None)
        except AnalysisException as e:
            raise ValueError(str(e).splitlines()[0]) from e
    elif first.upper() == "UNPIVOT":
        parts = _clauses(after, ("ON", "INTO", "NAME", "VALUE"))
        if not all(parts.get(w) for w in ("ON", "NAME", "VALUE")):
            raise ValueError("UNPIVOT needs ON, and INTO NAME ... VALUE ...")
        df, on = table(parts[""]), bare(parts["ON"])
        out = df.unpivot([c for c in df.columns if c not in on], on, parts["NAME"], parts["VALUE"])
    else:
        text = compiled(spark, text, lambda query: run_sql(spark, query, relations=relations))
        text = rewritten(text, relations)
        check_read_only(spark, text)
        text = with_columns(text, lambda source: spark.sql(f"SELECT * FROM {source}").columns)
        try:
            out = spark.sql(text)
        except AnalysisException as e:
            raise ValueError(str(e).splitlines()[0]) from e
    check_plan(out, sql)
    return out if limit is None else out.limit(limit)
