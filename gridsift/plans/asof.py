"""ASOF and POSITIONAL joins in SQL text: both sides become DataFrames, the library's operators join them, and the text reads the result.

Each table of a side is one column of the result, a struct; lateral subqueries give the structs' fields under the tables' own names, so
everything else in the statement stays as it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW
from ..operators.joins import asof_join, positional_join
from ..session import shared_dir
from .frames import without
from .tokens import Token, joined, solid, tokens

_STOPS = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "QUALIFY", "UNION", "EXCEPT", "INTERSECT", "WINDOW", "USING_SAMPLE")
_STARTS = ("JOIN", "LEFT", "RIGHT", "FULL", "CROSS", "INNER", "NATURAL", "ASOF", "POSITIONAL", "SEMI", "ANTI", "OUTER")

Run = Callable[[str], DataFrame]


def _alias(text: str) -> str:
    """The name by which a statement knows a table or subquery."""
    words = [t for t in tokens(text) if t.depth == 0 and t.kind in ("word", "quoted") and t.word() != "AS"]
    if not words:
        raise ValueError(f"a subquery in a join needs a name: {text.strip()[:60]}")
    return words[-1].text


def _tables(text: str) -> list[str]:
    """The names of the tables of a join tree."""
    parts, out, now, skip = tokens(text), [], [], False
    for t in [*parts, Token("sign", ",", 0)]:
        if t.depth == 0 and (t.text == "," or t.word() in _STARTS):
            if now and not skip and joined(now).strip():
                out.append(_alias(joined(now)))
            now, skip = [], False
        elif t.depth == 0 and t.word() in ("ON", "USING"):
            if joined(now).strip():
                out.append(_alias(joined(now)))
            now, skip = [], True
        else:
            now.append(t)
    return out


def _side(run: Run, text: str, names: list[str], first: int) -> DataFrame:
    """A side of a join: a struct for each of its tables, _side0, _side1, ..."""
    return run("SELECT " + ", ".join(f"struct({n}.*) AS _side{first + k}" for k, n in enumerate(names)) + f" FROM {text}")


def _named(expression: str, names: list[str], first: int) -> str:
    """An expression over the tables' names as one over the structs."""
    parts = tokens(expression)
    at = solid(parts)
    plain = {n.strip('`"').lower(): k for k, n in enumerate(names)}
    for a, b in zip(at, at[1:]):
        bare = parts[a].text.strip('`"').lower()
        if parts[b].text == "." and parts[a].kind in ("word", "quoted") and bare in plain:
            parts[a].kind, parts[a].text = "word", f"_side{first + plain[bare]}"
    return joined(parts)


def _over(df: DataFrame, expression: str, names: list[str], first: int):
    """The column of an expression, or None if df has not all that it names. A name alone is looked for in every table."""
    text = _named(expression, names, first)
    ways = [text] + [f"_side{first + k}.{text.strip()}" for k in range(len(names)) if "." not in text]
    for way in ways:
        try:
            df.select(F.expr(way))
            return F.expr(way)
        except AnalysisException:
            continue
    return None


def _conditions(text: str) -> list[tuple[str, str, str]]:
    """(left, operator, right) for the parts of a condition between ANDs."""
    parts, out, begin = tokens(text), [], 0
    for i, t in enumerate([*parts, Token("word", "AND", 0)]):
        if t.depth == 0 and t.word() == "AND":
            piece = parts[begin:i]
            sign = next((k for k, x in enumerate(piece) if x.depth == 0 and x.text in ("=", ">=", ">", "<=", "<")), None)
            if sign is None:
                raise ValueError(f"a condition of an ASOF join compares two values: {joined(piece).strip()}")
            out.append((joined(piece[:sign]).strip(), piece[sign].text, joined(piece[sign + 1 :]).strip()))
            begin = i + 1
    return out


_TURNED = {">=": "<=", "<=": ">=", ">": "<", "<": ">", "=": "="}


def _asof(run: Run, left: str, right: str, on: str, using: list[str], outer: bool) -> tuple[DataFrame, list[str], list[str]]:
    names = _tables(left)
    other = _alias(right)
    a, b = _side(run, left, names, 0), _side(run, right, [other], len(names))
    pairs = [(u, "=", u) for u in using[:-1]] + [(using[-1], ">=", using[-1])] if using else _conditions(on)
    keys, times = [], []
    for x, op, y in pairs:
        mine, theirs = _over(a, x, names, 0), _over(b, y, [other], len(names))
        if mine is None or theirs is None:
            mine, theirs, op = _over(a, y, names, 0), _over(b, x, [other], len(names)), _TURNED[op]
        if mine is None or theirs is None:
            raise ValueError(f"not a condition between both sides: {x} {op} {y}")
        (keys if op == "=" else times).append((mine, op, theirs))
    if len(times) != 1:
        raise ValueError("an ASOF join needs one condition by order")
    (mine, op, theirs), taken = times[0], f"_side{len(names)}"
    by = [f"_key{k}" for k in range(len(keys))] or ["_key0"]
    l_keys = [x.alias(n) for (x, _, _), n in zip(keys, by)] or [F.lit(0).alias("_key0")]
    r_keys = [x.alias(n) for (_, _, x), n in zip(keys, by)] or [F.lit(0).alias("_key0")]
    out = asof_join(a.select("*", mine.alias("_left_at"), *l_keys), b.select(taken, theirs.alias("_right_at"), *r_keys), by=by, left_on="_left_at", right_on="_right_at", take=[taken], op=op)
    out = out if outer else out.filter(F.col(taken).isNotNull())
    return out.drop("_left_at", *by), names, [other]


def _numbered(df: DataFrame) -> DataFrame:
    """df with row numbers in its own order. It is written first, as an order is not the same each time that it is made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/positional-{uuid.uuid4().hex}"
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    # One row for each partition.
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r._part):
        before.append((r._part, total))
        total += r.n
    starts = spark.createDataFrame(before, "_part long, _before long")
    return kept.join(F.broadcast(starts), "_part").withColumn(ROW, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def _positional(run: Run, left: str, right: str) -> tuple[DataFrame, list[str], list[str]]:
    names, other = _tables(left), _alias(right)
    a, b = _numbered(_side(run, left, names, 0)), _numbered(_side(run, right, [other], len(names)))
    return positional_join(a, b).drop(ROW), names, [other]


def compiled(spark: SparkSession, sql: str, run: Run) -> str:
    """sql with every ASOF and POSITIONAL join, innermost first, replaced by a view of its result. run: the DataFrame of a statement."""
    while True:
        parts = tokens(sql)
        at = solid(parts)
        marks = [k for k, (i, j) in enumerate(zip(at, at[1:])) if parts[i].word() == "POSITIONAL" and parts[j].word() == "JOIN" or parts[i].word() == "ASOF" and parts[j].word() in ("JOIN", "LEFT", "INNER")]
        if not marks:
            return sql
        k = max(marks, key=lambda m: (parts[at[m]].depth, -m))
        mark, depth = at[k], parts[at[k]].depth
        source = max((i for i in range(mark) if parts[i].word() == "FROM" and parts[i].depth == depth), default=None)
        select = max((i for i in range(mark) if parts[i].word() == "SELECT" and parts[i].depth == depth), default=None)
        if source is None or select is None or select > source:
            raise ValueError(f"{parts[mark].text} JOIN needs SELECT and FROM")
        join = next(i for i in range(mark, len(parts)) if parts[i].word() == "JOIN")
        words = [parts[i].word() for i in range(mark, join)]
        ends = [i for i in range(join + 1, len(parts)) if parts[i].depth < depth or parts[i].depth == depth and (parts[i].word() in (*_STOPS, *_STARTS) or parts[i].text == ",")]
        stop = ends[0] if ends else len(parts)
        clause = next((i for i in range(join, stop) if parts[i].depth == depth and parts[i].word() in ("ON", "USING")), stop)
        left, right, condition = joined(parts[source + 1 : mark]).strip(), joined(parts[join + 1 : clause]).strip(), joined(parts[clause + 1 : stop]).strip()
        using = [x.strip().strip('`"') for x in condition.strip("() \n\t").split(",")] if clause < stop and parts[clause].word() == "USING" else []
        if parts[mark].word() == "ASOF":
            if clause == stop:
                raise ValueError("an ASOF join needs ON or USING")
            out, names, others = _asof(run, left, right, condition, using, "LEFT" in words)
        else:
            out, names, others = _positional(run, left, right)
        view = f"_joined_{uuid.uuid4().hex}"
        out.createOrReplaceTempView(view)
        structs = [f"_side{i}" for i in range(len(names) + len(others))]
        # Columns of USING are those of the left side.
        fields = [f"{view}.{s}.*" + (f" EXCEPT ({', '.join(f'`{u}`' for u in using)})" if using and s == structs[-1] else "") for s in structs]
        tables = "".join(f", LATERAL (SELECT {f}) AS {n}" for f, n in zip(fields, [*names, *others]))
        head = without(joined(parts[select + 1 : source]), structs)
        sql = joined(parts[: select + 1]) + head + f" FROM {view}{tables} " + joined(parts[stop:])
