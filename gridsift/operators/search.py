"""Search of all cells of tables, compiled to one predicate per table.

A search is a filter on a scan: no shuffle, and column filters prune what is read. Context rows come from a range of row numbers
around the matches: the few matches are exploded to the numbers they want, and those are joined by (row number), so no window
over a whole table is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import like, number_of, text_of
from ..model import ROW, Condition, SearchQuery


def check_regex(df: DataFrame, pattern: str) -> None:
    """Raises ValueError for a pattern that cannot be compiled, before any row is read."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
    except Exception as e:
        raise ValueError(f"not a regular expression: {pattern!r}") from e


def cell_matches(cell: Column, query: SearchQuery) -> Column:
    text = text_of(cell)
    if query.mode == "exact":
        return text == query.text
    if query.mode == "wildcard":
        return like(text, query.text, any_case=True)
    if query.mode == "regex":
        return text.rlike(f"(?iu){query.text}")
    return F.contains(F.lower(text), F.lower(F.lit(query.text)))


#: All the characters that cells of a type can have as text. A longer query than they can spell needs no look at the column.
SPELLING = {"tinyint": "0123456789-", "smallint": "0123456789-", "int": "0123456789-", "bigint": "0123456789-", "date": "0123456789-+", "timestamp": "0123456789-+:. ", "timestamp_ntz": "0123456789-+:. ", "float": "0123456789-+.einfinitynan", "double": "0123456789-+.einfinitynan", "boolean": "truefals"}


def can_match(kind: str, query: SearchQuery) -> bool:
    """Whether a cell of this type can match at all, as far as the characters of the query tell."""
    if query.mode not in ("fulltext", "exact") or kind not in SPELLING:
        return True
    return set(query.text.lower()) <= set(SPELLING[kind])


def condition_holds(condition: Condition) -> Column:
    """Comparisons are of numbers where both sides are numbers, else of text."""
    text, op = text_of(F.col(f"`{condition.column}`")), condition.operator.upper()
    if op in ("LIKE", "ILIKE"):
        return like(text, condition.value, any_case=op == "ILIKE")
    value = F.lit(condition.value)
    if op in ("=", "=="):
        return text == value
    if op in ("!=", "<>"):
        return text != value
    compare = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}[op]
    a, b = number_of(text), number_of(value)
    return F.when(a.isNotNull() & b.isNotNull(), compare(a, b)).otherwise(compare(text, value))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def predicate(df: DataFrame, query: SearchQuery) -> tuple[Column, list[tuple[str, Column]]]:
    """Whether a row is found, and by column whether its cell matches.

    Without the searched column no row matches (so all do if inverted); without a condition's column no row is found.
    Inversion is of the match alone: conditions must still hold.
    """
    if query.mode == "regex":
        check_regex(df, query.text)
    names = data_columns(df)
    targets = [c for c in names if query.column is None or c == query.column]
    kinds = dict(df.dtypes)
    cells = [(c, cell_matches(F.col(f"`{c}`"), query)) for c in targets if can_match(kinds[c], query)]
    found = reduce(Column.__or__, [m for _, m in cells], F.lit(False))
    if query.invert:
        found = ~found
    for c in query.conditions:
        found = found & (condition_holds(c) if c.column in names else F.lit(False))
    return found, cells


def search_table(df: DataFrame, query: SearchQuery) -> DataFrame:
    """The rows of df that are found, with matched_columns (array of names; empty if inverted). A limit takes the first in order of row numbers, if there are any."""
    found, cells = predicate(df, query)
    if query.invert or not cells:
        matched = F.array().cast("array<string>")
    elif len(cells) == 1:
        matched = F.array(F.lit(cells[0][0]))
    else:
        # At least one column matches. As text and back, which is compiled, where a function over arrays is not.
        matched = F.split(F.concat_ws("\x01", *[F.when(m, F.lit(c)) for c, m in cells]), "\x01")
    out = df.filter(found).withColumn("matched_columns", matched)
    if query.limit is None:
        return out
    return (out.orderBy(ROW) if ROW in df.columns else out).limit(query.limit)


def with_context(df: DataFrame, hits: DataFrame, lines: int, partition: list[str] | None = None) -> DataFrame:
    """hits with before and after: arrays of up to so many rows (structs of df's columns), in order of row number.

    Row numbers count within partition (columns of df), if given.
    """
    keys, names = partition or [], [c for c in df.columns if c != ROW]
    offsets = F.array(*[F.lit(k) for k in range(-lines, lines + 1) if k])
    wanted = hits.select(*keys, F.col(ROW).alias("_hit"), F.explode(F.transform(offsets, lambda k: F.col(ROW) + k)).alias(ROW))
    near = wanted.join(df, [*keys, ROW]).groupBy(*keys, "_hit").agg(F.array_sort(F.collect_list(F.struct(ROW, *names))).alias("_rows"))
    out = hits.join(near.withColumnRenamed("_hit", ROW), [*keys, ROW], "left")
    rows = F.coalesce("_rows", F.array())
    side = lambda keep: F.transform(F.filter(rows, keep), lambda r: F.struct(*[r[n].alias(n) for n in names]))
    return out.withColumns({"before": side(lambda r: r[ROW] < F.col(ROW)), "after": side(lambda r: r[ROW] > F.col(ROW))}).drop("_rows")


#: A limit up to here is met by rows that pass through the driver.
EARLY_ROWS = 100_000


def search(tables: list[tuple[str, str, DataFrame]], query: SearchQuery, in_order: bool = False) -> DataFrame:
    """file, sheet, row_index, col_names, cells, matched_columns (and before, after: arrays of cells) over (file, sheet, table)s: one lazy union. A limit takes the first tables' first rows.

    in_order: the tables' partitions are in order of their row numbers, as in a scan of one file. A limit up to EARLY_ROWS then looks at the first partition,
    and at more and more of the next ones only while rows are missing; so little is read where matches are frequent. That happens at once, not
    when the result is used. Without it, all rows are searched and the first found ones kept.
    """
    parts = []
    for place, (file, sheet, df) in enumerate(tables):
        if query.sheet is not None and sheet != query.sheet:
            continue
        names = data_columns(df)
        cells = lambda r=None: F.array(*[text_of(F.col(f"`{c}`") if r is None else r[c]) for c in names]).cast("array<string>")
        hits = search_table(df, SearchQuery(**{**query.__dict__, "limit": None}))
        more: list[Column] = []
        if query.context_lines:
            hits = with_context(df, hits, query.context_lines)
            more = [F.transform(side, lambda r: cells(r)).alias(side) for side in ("before", "after")]
        parts.append(hits.select(F.lit(file).alias("file"), F.lit(sheet).alias("sheet"), F.col(ROW).alias("row_index"), F.array(*[F.lit(c) for c in names]).cast("array<string>").alias("col_names"), cells().alias("cells"), "matched_columns", *more, F.lit(place).alias("_place")))
    if not parts:
        raise ValueError("no table to search")
    out = reduce(DataFrame.unionByName, parts)
    if in_order and query.limit is not None and query.limit <= EARLY_ROWS and not query.context_lines:
        return out.sparkSession.createDataFrame(out.drop("_place").take(query.limit), out.drop("_place").schema)
    return (out if query.limit is None else out.orderBy("_place", "row_index").limit(query.limit)).drop("_place")


def limited(found: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first rows, in order of file, sheet and row number as far as found has them, and whether there are more."""
    order = [c for c in ("file", "sheet", "row_index", ROW) if c in found.columns]
    return (found.orderBy(*order) if order else found).limit(limit), found.limit(limit + 1).count() > limit


def search_stats(tables: list[tuple[str, str, DataFrame]], query: SearchQuery) -> DataFrame:
    """file, sheet, rows_searched, matches: one aggregate per table that the search visits."""
    parts = []
    for file, sheet, df in tables:
        if query.sheet is None or sheet == query.sheet:
            found, _ = predicate(df, query)
            parts.append(df.agg(F.count("*").alias("rows_searched"), F.count_if(found).alias("matches")).select(F.lit(file).alias("file"), F.lit(sheet).alias("sheet"), "rows_searched", "matches"))
    return reduce(DataFrame.unionByName, parts)


def value_counts(found: DataFrame, column: str) -> DataFrame:
    """value, n: how often each non-empty value of a column occurs, most frequent first, then by value."""
    value = text_of(F.col(f"`{column}`"))
    return found.select(value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def spans(text: Column, query: SearchQuery) -> Column:
    """The parts of a text to be highlighted: an array of the matching texts in order."""
    if query.mode == "fulltext":
        body = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in query.text)
        return F.regexp_extract_all(text, F.lit(f"(?iu){body}"), F.lit(0))
    if query.mode == "regex":
        return F.regexp_extract_all(text, F.lit(f"(?iu){query.text}"), F.lit(0))
    return F.when(cell_matches(text, query), F.array(text)).otherwise(F.array().cast("array<string>"))
