"""Operators that pass columns through do so whatever those are called."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import language_id, mixing, order_minhash, passages, quality_gam, sentencepiece_codec, suffix_dedup, url_filter
from lectern.llm.common import passing
from lectern.llm.queries import model_bytes

NAMES = ["_n", "_key", "_s", "_salt", "_said", "_md5", "_part", "_source", "_id", "_spans", "_checked", "_whole", "_copies", "_made", "_p", "_many", "_first", "other_columns", "n", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 90}" for i in range(400))
    rows = [(1, long, "s"), (2, long, "s"), (3, "a few words of its own", None), (4, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("doc_id", *(F.concat(F.lit(f"{c}/"), F.col("doc_id")).alias(c) for c in NAMES), "text", "source")


def language(docs):
    labelled = docs.select("doc_id", "text", F.lit("en").alias("lang"))
    return language_id.identify(docs, language_id.learn(labelled))


def quality(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return quality_gam.scored(docs, quality_gam.learn(docs.select("doc_id", "text"), labels))


OPERATORS = {
    "language": language,
    "quality": quality,
    "codec": lambda d: sentencepiece_codec.encoded(d, model_bytes()),
    "mix": mixing.plan_mix,
    "mixed": mixing.mixed_documents,
    "suffixes": suffix_dedup.remove_repeats,
    "near": order_minhash.near_duplicates,
    "one_of_each": order_minhash.one_of_each,
    "passages": passages.without_passages,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_come_back_as_they_were(docs, name):
    made = OPERATORS[name](docs)
    assert [c for c in made.columns if c in docs.columns] == docs.columns
    rows = made.collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3, 4} and rows
    assert all(r[c] == f"{c}/{r.doc_id}" for r in rows for c in NAMES)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://b.com/fr/"), (2, None)], "page_id long, url string")
    pages = pages.select("page_id", "url", F.lit("<a href='http://b.com/'>b</a>").alias("html"), *(F.lit(c).alias(c) for c in NAMES))
    rows = url_filter.judge_pages(pages).collect()
    assert len(rows) == 4 and all(r[c] == c for r in rows for c in NAMES)
    assert sorted((str(r.page_id), r.host, r.verdict) for r in rows if r.rule) == [("1", "a.org", "allow")] * 2 + [("None", "b.com", "allow")]


def test_a_column_of_a_results_name_is_replaced(spark):
    @passing("a")
    def operator(df, by="a"):
        return df.withColumn("b", F.col(by) + 1)

    df = spark.createDataFrame([(1, 9, 5)], "a int, b int, c int")
    assert operator(df).collect()[0].asDict() == {"a": 1, "c": 5, "b": 2}
    assert operator(df, by="c").collect()[0].asDict() == {"a": 1, "c": 5, "b": 6}
