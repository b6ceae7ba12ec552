"""Token counts of fields and sections: whole documents are encoded once, and token spans meet section spans.

A document is its fields joined by newlines. A field is one section, or one for each of its lines; a section reaches up to the next
one's start, so the newline between them belongs to the earlier. Tokens that go over a boundary are allocated by a rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_bpe
from .common import chunks, in_batches

RULES = ("start", "most", "split")


def allocated(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens go beyond it. bounds: the sections' starts, ascending from 0.

    rule: "start" gives a token to the section of its first code point, "most" to that with most of its code points (the
    earliest of equals), "split" to all in proportion.
    """
    n = len(bounds)
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends, starts + 1), "left") - 1
    counts = np.bincount(first, minlength=n).astype(np.float64)
    over = np.flatnonzero(last > first)
    crossing = np.bincount(first[over], minlength=n)
    if rule != "start":
        edges = [*bounds.tolist(), np.iinfo(np.int64).max]
        for t in over:
            a, b = int(starts[t]), int(ends[t])
            parts = [(min(b, edges[s + 1]) - max(a, edges[s]), s) for s in range(first[t], last[t] + 1)]
            counts[first[t]] -= 1
            if rule == "most":
                counts[max(parts, key=lambda p: (p[0], -p[1]))[1]] += 1
            else:
                for width, s in parts:
                    counts[s] += width / (b - a)
    return counts, crossing


def section_tokens(docs: DataFrame, *, fields: list[str], by_line: set[str], ranks: str, pattern: str, id_col: str = "doc_id", rule: str = "start") -> DataFrame:
    """One row per section: id, field, section (from 0 within the field), start, end (code points of the joined document), n_tokens (double), n_crossing (long).

    The counts of a document's sections add up to its tokens. A null field counts as empty, an empty field is an empty section, very long
    fields are encoded in slices; repeated rows each give their sections; an empty table gives an empty result; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    long = T.LongType()
    kinds = [("id", docs.schema[id_col].dataType), ("field", T.StringType()), ("section", long), ("start", long), ("end", long), ("n_tokens", T.DoubleType()), ("n_crossing", long)]
    schema = T.StructType([T.StructField(n, k) for n, k in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            for part in chunks(batch, list(range(1, len(fields) + 1))):
                took, field, section, start, end, whole = [], [], [], [], [], []
                for row, texts in enumerate(zip(*[part.column(k + 1).to_pylist() for k in range(len(fields))])):
                    texts, at = [t or "" for t in texts], 0
                    for name, text in zip(fields, texts):
                        lines = text.split("\n") if name in by_line else [text]
                        upto = list(accumulate([len(x) + 1 for x in lines], initial=at))
                        took += [row] * len(lines)
                        field += [name] * len(lines)
                        section += range(len(lines))
                        start += upto[:-1]
                        end += [x - 1 for x in upto[1:]]
                        at = upto[-1]
                    whole.append("\n".join(texts))
                ids, counts = bpe.encode_texts(whole)
                starts, ends = bpe.spans(whole, ids, counts)
                # All documents of the part on one axis, each a place apart from the next.
                base = np.cumsum([0, *[len(x) + 1 for x in whole]])[:-1]
                shift = np.repeat(base, counts)
                bounds = np.array(start, np.int64) + base[np.array(took, np.int64)]
                tokens, crossing = allocated(starts + shift, ends + shift, bounds, rule)
                arrays = [part.column(0).take(pa.array(took, pa.int32())), pa.array(field), *[pa.array(x, pa.int64()) for x in (section, start, end)], pa.array(tokens), pa.array(crossing, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return in_batches(docs.select(id_col, *fields)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
