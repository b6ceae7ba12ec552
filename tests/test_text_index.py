"""The substring index gives the rows of a plain search, from fewer files."""

import pytest

from gridsift.model import Condition, SearchQuery
from gridsift.operators.search import search_table
from gridsift.operators.text_index import _literals, build_text_index, indexed_search, needed
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "a table")
    docs = spark.range(400).select("id", F.concat(F.lit("common words and number "), "id", F.when(F.col("id") == 37, " Zebra-Äpfel ſix").when(F.col("id") == 211, " zeBRA crossing").otherwise("")).alias("text"), (F.col("id") * 1.5).alias("v"), F.floor(F.col("id") / 100).alias("p"))
    docs.repartition(4, F.floor(F.col("id") / 20)).sortWithinPartitions("id").write.partitionBy("p").parquet(path)
    return path, f"{path} index"


QUERIES = [
    SearchQuery("zebra"), SearchQuery("äpfel"), SearchQuery("ZEBRA", column="text"), SearchQuery("zebra", column="v"), SearchQuery("no such text"), SearchQuery("ze"), SearchQuery(""),
    SearchQuery("common"), SearchQuery("316.5"), SearchQuery("common words and number 12", mode="exact"), SearchQuery("%zebra_cro%", mode="wildcard"), SearchQuery("%Äpf%", mode="wildcard"),
    SearchQuery("zebra( |-)cross", mode="regex"), SearchQuery("(?:zeb)+ra|apfel", mode="regex"), SearchQuery("six", mode="regex"), SearchQuery("number 2[0-3]\\d\\b", mode="regex"), SearchQuery("zebra", invert=True),
    SearchQuery("zebra", conditions=(Condition("v", ">", "100"),)),
]


def test_same_rows_from_fewer_files(spark, table):
    path, index = table
    n = build_text_index(spark, path, index)
    whole = spark.read.parquet(path)
    for query in QUERIES:
        found = indexed_search(spark, path, index, query)
        want = search_table(whole, query)
        assert found.df.columns == want.columns and found.files == n > 4
        assert sorted(map(repr, found.df.collect())) == sorted(map(repr, want.collect())), query
    read = lambda q: indexed_search(spark, path, index, q).files_read
    assert read(SearchQuery("zebra")) == 2 and read(SearchQuery("äpfel")) == 1 and read(SearchQuery("no such text")) == 0
    assert read(SearchQuery("zebra( |-)cross", mode="regex")) < n / 2 and read(SearchQuery("%zebra_cro%", mode="wildcard")) == 1
    assert read(SearchQuery("common")) == read(SearchQuery("ze")) == read(SearchQuery("zebra", invert=True)) == n
    # A file that the index does not know is read.
    spark.createDataFrame([(9, "zebra late", 1.0, 7)], "id long, text string, v double, p long").write.partitionBy("p").mode("append").parquet(path)
    late = indexed_search(spark, path, index, SearchQuery("zebra"))
    assert late.df.count() == 3 and (late.files, late.files_read) == (n + 1, 3)


def test_texts_that_a_pattern_needs(spark):
    assert _literals("abc(def)+gh") == ["abc", "def", "gh"] and _literals("a(bc)d") == ["abcd"] and _literals("ab|cd") == [] and _literals("x(?i)abc") == []
    assert _literals("abc?de") == ["ab", "de"] and _literals("[ab]cde") == ["cde"] and _literals("\\Qa.b\\E") == [] and _literals("(?<n>abc)") == []
    assert needed(spark, SearchQuery("%abc_de%fgh", mode="wildcard")) == ["abc", "fgh"] and needed(spark, SearchQuery("Motor-Bone", mode="regex")) == ["motor-bone"]
    assert needed(spark, SearchQuery("zipper", mode="regex")) == ["pper"]
