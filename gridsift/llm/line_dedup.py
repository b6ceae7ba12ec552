"""Line dedup: drop lines that many documents share, except in one of those documents.

Plan: lines long enough to count are exploded, normalised and hashed to 128 bits (two 64-bit hashes); distinct documents are
counted per hash; what reaches the threshold is a table of its own (16 bytes of hash, the keeping document). The lines
then meet that table: its most frequent hashes, 1,000 at most, are broadcast, so that no hash left for the shuffle join can
hold more than a thousandth of the lines. Only (document, positions) return to the documents, whose lines are put
together again by position. A bitmap of bounded size is broadcast, by which documents that lose nothing stay where they are: only texts that
lose lines (and some that share their bits) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, ascii_lower, hidden, position, restored, stored

HOT_KEYS = 1000
#: Bits of the bitmap: eight for each document that loses lines, within these bounds. In 64-bit words it has 1,048,576 rows at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _judged(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """docs hidden, with lines (array), n_lines, n_dropped and kept (text)."""
    src = hidden(docs)
    doc_id, text = F.col(position(docs, id_col)), F.coalesce(F.col(position(docs, text_col)), F.lit(""))
    split = F.split(text, "\n", -1)
    lines = (
        src.select(doc_id.alias("id"), F.xxhash64(text).alias("t"), F.posexplode(split).alias("pos", "line"))
        .filter(F.octet_length("line") >= min_chars)
        .withColumn("key", _key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    shared = stored(
        lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs),
        "shared-lines",
    )
    few = shared.count() <= BROADCAST_ROWS
    hot = shared if few else shared.orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS)
    found = lines.join(F.broadcast(hot.select("h1", "h2", "keeper")), ["h1", "h2"], "inner" if few else "left")
    if not few:
        # Lines already matched get a key of their own, so they spread out instead of meeting at one reducer.
        is_cold = F.col("keeper").isNull()
        found = found.withColumns({"cold": is_cold, "k1": F.when(is_cold, F.col("h1")).otherwise(F.xxhash64("id", "t", "pos"))})
        rest = shared.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").select(
            F.lit(True).alias("cold"), F.col("h1").alias("k1"), "h2", F.col("keeper").alias("keeper2")
        )
        found = found.join(rest, ["cold", "k1", "h2"], "left").withColumn("keeper", F.coalesce("keeper", "keeper2"))
        found = found.filter(F.col("keeper").isNotNull())
    drops = found.filter(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "t").agg(F.collect_list("pos").alias("drops"))
    drops = stored(drops.withColumnsRenamed({"id": "drop_id", "t": "drop_t"}), "drops")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * drops.count()).bit_length()))
    place = lambda i, t: F.pmod(F.xxhash64(i, t), F.lit(bits))
    at = drops.select(place("drop_id", "drop_t").alias("at"))
    bitmap = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("flags"))
    placed = src.withColumn("t", F.xxhash64(text)).withColumn("at", place(doc_id, F.col("t")))
    marked = placed.join(F.broadcast(bitmap), F.floor(F.col("at") / 64) == F.col("word"), "left")
    marked = marked.withColumn("moves", F.coalesce(F.expr("shiftright(flags, cast(at % 64 as int)) & 1L") == 1, F.lit(False)))
    # The lines are split below the join, which keeps them one array: an expression above it would be split anew for each line.
    columns = [*src.columns, "t"]
    quiet = marked.filter("NOT moves").select(*columns, F.lit(None).cast("array<int>").alias("drops")).withColumn("lines", split)
    moved = marked.filter("moves").select(*columns).withColumn("lines", split)
    moved = moved.join(drops, doc_id.eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left").drop("drop_id", "drop_t")
    both = quiet.unionByName(moved)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i))), "\n")
    n = F.size("lines").cast("long")
    return both.withColumns(
        {"kept": kept, "n_lines": n, "n_dropped": F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct("drops"))).cast("long")}
    )


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: its id, n_lines, n_dropped, kept (text).

    A text is split at \\n. A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs distinct ids lose all their lines but those of the largest such id.

    Null or empty text: one empty line. A null id counts as no document and is never the largest. Rows that share an id are
    one document for the count, and all are kept if theirs is the largest id; repeated rows each give a row. An
    empty table gives an empty result. Other columns are not read.
    """
    out = _judged(docs.select(id_col, text_col), id_col, text_col, min_chars, min_docs)
    return out.select(F.col("c0").alias(id_col), "n_lines", "n_dropped", "kept")


def drop_shared_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with their columns as they were, but text without the lines that line_report() drops (and n_chars, if there is such a column, set anew).

    No row goes: a document that loses every line stays with an empty text. A null text stays null.
    """
    out = _judged(docs, id_col, text_col, min_chars, min_docs)
    text = position(docs, text_col)
    changed = {text: "kept_text"}
    out = out.withColumn("kept_text", F.when(F.col(text).isNotNull(), F.col("kept")))
    if "n_chars" in [c.lower() for c in docs.columns]:
        n = position(docs, "n_chars")
        changed[n] = "kept_chars"
        out = out.withColumn("kept_chars", F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col(n)).cast(docs.schema[[c.lower() for c in docs.columns].index("n_chars")].dataType))
    return restored(out, docs, changed)
