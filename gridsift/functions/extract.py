"""Tables inside columns: texts or files' bytes held in a DataFrame are parsed on the executors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.formats import parse
from .names import column_names

_FIELDS = [("sheet_no", T.IntegerType(), pa.int32()), ("sheet", T.StringType(), pa.string()), ("row", T.LongType(), pa.int64()), ("col", T.IntegerType(), pa.int32()), ("name", T.StringType(), pa.string()), ("value", T.StringType(), pa.string())]


def extract_cells(df: DataFrame, *, id_col: str, content_col: str, kind: str) -> DataFrame:
    """id, sheet_no, sheet, row, col, name, value: a row for every cell of every table found in a text or binary column. Null content has no tables."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(n, t) for n, t, _ in _FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, out = [], [[] for _ in _FIELDS]
            for i, content in enumerate(batch.column(1)):
                data = content.as_py()
                if data is None:
                    continue
                for k, t in enumerate(x.widened() for x in parse(data.encode() if isinstance(data, str) else data, f"table.{kind}", kind)):
                    names = column_names(t.headers)
                    for r, row in enumerate(t.rows):
                        for c, name in enumerate(h or n for h, n in zip(t.headers, names)):
                            took.append(i)
                            for column, value in zip(out, (k, t.name, r, c, name, row[c])):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int32())), *[pa.array(v, t) for v, (_, _, t) in zip(out, _FIELDS)]], names=schema.names)

    return df.select(id_col, content_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
