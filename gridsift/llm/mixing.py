"""Mixing sources to target weights by iterative proportional fitting (raking), and sampling by the calibrated probabilities.

Tokens are summed by cell (source, language, topic). Each round scales every cell so that one dimension's marginals meet their
targets, then the next dimension's, until no marginal is off by more than TOLERANCE. A document's probability is its cell's factor over a scale:
kept tokens meet the targets in expectation, and no document is repeated. The scale is set so that cells with SPILL of the tokens at most ask
for more than all their documents: tiny cells with huge factors simply stay whole and do not thin out all the others. Chance comes from a hash
of the id, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import BROADCAST_ROWS, hidden, position, restored, stored

DIMS = ["source", "lang", "topic"]
#: Rounds end when all marginals are this near their targets, or after so many (targets that contradict each other are never all met; the last dimension's are).
TOLERANCE, MOST_ROUNDS = 1e-9, 40
#: The share of tokens in cells whose factor may lie above the scale.
SPILL = 0.01
#: Factors are put in order by bins, so many for each doubling.
BINS = 64

#: Topics by form: signs, and how many of them in 1000 bytes make the topic. Of several, that which is furthest above its number; the earliest of equals.
FORMS = {"table": ("|\t", 5.0), "contact": ("@", 0.5), "markup": ("<{}=", 5.0), "symbols": ("#$%&*", 5.0), "speech": ('?"', 6.0), "list": ("\n", 20.0)}
#: And of the rest, by length: fewer characters than this.
LENGTHS = (("note", 500), ("article", 4000))

Targets = Mapping[str, Mapping[str, float]]


def described(text: Column) -> Column:
    """topic and n_tokens of a text, from one pass over it.

    n_tokens: the number of words [^\\x20\\x09-\\x0D]+. topic: by form, where no classifier's label is at hand: what signs there are many of, else how long
    the text is. Null is an empty text.
    """
    text = F.coalesce(text, F.lit(""))
    signs = "".join(dict.fromkeys("".join(s for s, _ in FORMS.values())))
    # Each run between blanks and signs becomes one letter: the signs and the words stay to be counted in what is left.
    left = F.regexp_replace(text, "[^ \\x09-\\x0D" + "".join(f"\\x{ord(c):02x}" for c in signs) + "]++", "w")
    forms = F.array(*[F.lit(f) for f in FORMS])

    def count(x: Column) -> Column:
        size, n, left = x["size"], x["n"], x["left"]
        lost = lambda sign: F.octet_length(left) - F.octet_length(F.replace(left, F.lit(sign), F.lit("")))
        scores = F.array(*[reduce(Column.__add__, map(lost, signs)) * 1000.0 / (F.greatest(size, F.lit(1)) * least) for signs, least in FORMS.values()])
        best = lambda s: F.when(F.array_max(s) >= 1.0, F.get(forms, (F.array_position(s, F.array_max(s)) - 1).cast("int")))
        by_length = reduce(lambda w, x: w.when(n < x[1], x[0]), LENGTHS[1:], F.when(n < LENGTHS[0][1], LENGTHS[0][0])).otherwise("book")
        n_tokens = F.regexp_count(left, F.lit(r"[^ \x09-\x0D]++")).cast("long")
        return F.struct(F.coalesce(F.get(F.transform(F.array(scores), best), 0), by_length).alias("topic"), n_tokens.alias("n_tokens"))

    # Inside a function of its own each value is made once.
    return F.get(F.transform(F.array(F.struct(F.octet_length(text).alias("size"), F.char_length(text).alias("n"), left.alias("left"))), count), 0)


def _with_targets(cells: DataFrame, d: str, named: Mapping[str, float], power: float) -> DataFrame:
    """cells with target_d: the tokens that d's value shall have."""
    weight = F.lit(None).cast("double")
    for value, share in named.items():
        weight = F.when(F.col(d) == value, float(share)).otherwise(weight)
    values = cells.groupBy(d).agg(F.sum("tokens").alias("own")).withColumns({"weight": weight, "raised": F.pow(F.col("own").cast("double"), F.lit(power))})
    sums = values.agg(F.sum("own"), F.sum("weight"), F.sum(F.when(F.col("weight").isNull(), F.col("raised")))).first()
    total, present, others = (float(x or 0) for x in sums)
    rest = max(0.0, 1.0 - sum(named.values())) if named else 1.0
    norm = present + (rest if others else 0.0) or 1.0
    share = F.coalesce("weight", rest * F.col("raised") / F.lit(others or 1.0))
    return cells.join(values.select(d, (share * (total / norm)).alias(f"target_{d}")), d)


def raked(cells: DataFrame, dims: list[str], power: float, targets: Targets | None = None) -> tuple[DataFrame, float]:
    """cells (dims, tokens) with target_<dim> and factor, and the largest relative error of a marginal that is left.

    targets: shares of tokens by value, for any of the dimensions. Values that are not named share what is left (nothing, if the named shares sum
    to 1 or more) in proportion to their tokens raised to power; shares of values that do not occur go to the others in proportion.
    """
    for d in dims:
        cells = _with_targets(cells, d, (targets or {}).get(d, {}), power)
    cells, error = stored(cells.withColumns({"factor": F.lit(1.0), "off": F.lit(0.0)}), "cells"), float("inf")
    # A table this small is one partition, whose sums need no shuffle; a larger one is summed in parts before its values meet.
    few = cells.count() <= BROADCAST_ROWS
    for _ in range(MOST_ROUNDS // 2):
        cells = cells.coalesce(1) if few else cells
        for k in range(2 * len(dims)):
            d = dims[k % len(dims)]
            has = F.sum(F.col("tokens") * F.col("factor"))
            cells = cells.withColumn("has", has.over(W.Window.partitionBy(d))) if few else cells.join(cells.groupBy(d).agg(has.alias("has")), d)
            off = F.when(F.col(f"target_{d}") > 0, F.abs(F.col("has") / F.col(f"target_{d}") - 1)).otherwise(0.0)
            # The error before the second time around: of the marginals that the steps since then have moved.
            cells = cells.withColumn("off", F.greatest("off", off) if k > len(dims) else F.lit(0.0) if k < len(dims) else off)
            cells = cells.withColumn("factor", F.when(F.col("has") > 0, F.col("factor") * F.col(f"target_{d}") / F.col("has")).otherwise(F.col("factor"))).drop("has")
        cells = stored(cells, "cells")
        error = cells.filter("tokens > 0").agg(F.max("off")).first()[0] or 0.0
        if error <= TOLERANCE:
            break
    return cells, error


def _scale(cells: DataFrame) -> float:
    """The factor that means all documents: cells above it hold SPILL of the tokens at most."""
    bins = cells.filter("tokens > 0 AND factor > 0").groupBy(F.floor(F.log2("factor") * BINS).alias("bin")).agg(F.sum("tokens").alias("tokens"))
    # Some thousand bins at most: doubles have 2,100 doublings, and factors of one corpus far fewer.
    above = W.Window.orderBy(F.desc("bin")).rowsBetween(W.Window.unboundedPreceding, 0)
    bins = bins.withColumns({"above": F.sum("tokens").over(above), "total": F.sum("tokens").over(W.Window.partitionBy())})
    top = bins.filter(F.col("above") > SPILL * F.col("total")).agg(F.max("bin")).first()[0]
    return 1.0 if top is None else 2.0 ** ((top + 1) / BINS)


def chance(doc_id: Column, seed: int) -> Column:
    """A number from 0 to below 1 for an id: the first 52 bits of a digest."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _described(src: DataFrame, text: Column, source: Column, lang: Column, topic: Column | None) -> DataFrame:
    """src with DIMS and n_tokens."""
    of = described(text)
    values = {"source": source, "lang": lang, "topic": of["topic"] if topic is None else topic}
    return src.withColumns({d: F.coalesce(c.cast("string"), F.lit("")) for d, c in values.items()} | {"n_tokens": of["n_tokens"]})


def _cells(facts: DataFrame) -> DataFrame:
    return stored(facts.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")


def _calibrated(facts: DataFrame, doc_id: Column, power: float, targets: Targets | None, seed: int) -> DataFrame:
    """facts (with DIMS and n_tokens) with probability and selected."""
    cells, _ = raked(_cells(facts), DIMS, power, targets)
    probability = F.least(F.lit(1.0), F.col("factor") / F.lit(_scale(cells)))
    cells = cells.select(*DIMS, F.when(F.col("tokens") > 0, probability).otherwise(1.0).alias("probability"))
    # As many cells as combinations occur. Beyond the bound the join is shuffled, and skewed cells are split by AQE.
    few = cells.count() <= BROADCAST_ROWS
    out = facts.join(F.broadcast(cells) if few else cells, DIMS, "left")
    return out.withColumn("selected", chance(doc_id, seed) < F.col("probability"))


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> DataFrame:
    """id, DIMS and n_tokens of each row: stored, so the texts are read once."""
    own = [id_col, text_col, source_col, lang_col, *[topic_col] * bool(topic_col)]
    src = docs.select(*[F.col(c) for c in own]).toDF("id", "x", "s", "l", *["t"] * bool(topic_col))
    facts = _described(src, F.col("x"), F.col("s"), F.col("l"), F.col("t") if topic_col else None)
    return stored(facts.select("id", *DIMS, "n_tokens"), "facts")


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, power: float = 0.9, targets: Targets | None = None, seed: int = 17) -> DataFrame:
    """id, source, lang, topic, n_tokens (words), probability, selected of each row.

    targets: see raked(); the dimensions are source, lang and topic. Null source, language or topic counts as the empty string. A document without
    words has probability 1 if its cell has none, else its cell's. Repeated rows are weighed each and share their fate, as chance goes by the id; an
    empty table gives an empty result; other columns are not read.
    """
    out = _calibrated(_facts(docs, id_col, text_col, source_col, lang_col, topic_col), F.col("id"), power, targets, seed)
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", "probability", "selected")


def marginals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, power: float = 0.9, targets: Targets | None = None) -> DataFrame:
    """dim, value, tokens, target_share, expected_share (of the kept tokens), kept_share (of the value's own): how near mixture() comes to its targets."""
    cells, _ = raked(_cells(_facts(docs, id_col, text_col, source_col, lang_col, topic_col)), DIMS, power, targets)
    cells = cells.withColumn("kept", F.col("tokens") * F.least(F.lit(1.0), F.col("factor") / F.lit(_scale(cells))))
    all_cells = cells.agg(F.sum("tokens").alias("all_tokens"), F.sum("kept").alias("all_kept"))
    parts = [cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), F.first(f"target_{d}").alias("target"), F.sum("kept").alias("kept")) for d in DIMS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).crossJoin(F.broadcast(all_cells))  # of one row
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return rows.select("dim", "value", "tokens", share("target", "all_tokens").alias("target_share"), share("kept", "all_kept").alias("expected_share"), share("kept", "tokens").alias("kept_share"))


def sample_mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", power: float = 0.9, targets: Targets | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs that mixture() selects, columns as they were: nulls, repeated rows and an empty table as there."""
    src = hidden(docs)
    at = lambda c: F.col(position(docs, c))
    facts = _described(src, at(text_col), at(source_col), at(lang_col), None)
    return restored(_calibrated(facts, at(id_col), power, targets, seed).filter("selected"), docs)
