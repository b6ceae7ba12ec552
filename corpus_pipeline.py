"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing of sources, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridsift.llm.bpe import with_tokens
from gridsift.llm.common import release, stored, written
from gridsift.llm.line_dedup import drop_shared_lines
from gridsift.llm.mixing import sample_mixture
from gridsift.llm.ngram_join import keep_one
from gridsift.llm.quality import keep_good
from gridsift.llm.queries import ranks_and_pattern


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null, empty and very short texts are rejected, repeated rows share their fate, an empty table stays empty, extra columns stay."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document goes; texts lose shared lines. Null texts stay null, rows with one id are one document, repeated rows stay, an empty table stays empty, extra columns stay."""
    return drop_shared_lines(docs, min_chars=40, min_docs=5)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id. Null and empty texts all stay; of rows repeated with id and text one stays; extra columns stay."""
    return keep_one(docs, size=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities. Null source, language and topic count as empty; documents without words stay as their cell does; repeated rows share their fate; extra columns stay."""
    return sample_mixture(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with token_ids (null for a null text) and n_tokens. Columns of these names are replaced; repeated rows stay, an empty table stays empty."""
    ranks, pattern = ranks_and_pattern()
    return with_tokens(docs, ranks=ranks, pattern=pattern)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL has no byte-level BPE; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents. Each one's result is written, and what it and those before it wrote besides is deleted."""
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        release(spark, begin, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
