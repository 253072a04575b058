"""Search for many needles at once through postings of trigrams: an index written once, candidates by intersection, then the exact test."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Postings of a needle's rarest grams that are intersected.
RAREST = 3
#: Folders of the index; a gram's postings lie in one.
BUCKETS = 64


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case, and its last two characters, so that each pair of characters begins a gram."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def runs(chars: Column) -> Column:
        each = F.transform(chars, lambda c, i: F.concat(c, F.coalesce(F.get(chars, i + 1), F.lit("")), F.coalesce(F.get(chars, i + 2), F.lit(""))))
        return F.array_distinct(F.slice(each, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))))

    # The characters are computed once a row, not once in each step.
    return F.transform(F.array(F.filter(F.split(low, ""), lambda c: c != "")), runs)[0]


def _bucket(gram: Column) -> Column:
    # By the first two characters: a needle of two finds all grams that begin with it in one folder.
    return F.pmod(F.xxhash64(F.substring(gram, 1, 2)), F.lit(BUCKETS)).cast("int").alias("bucket")


def write_index(items: DataFrame, key: list[str], path: str, text: str = "text") -> None:
    """Writes (bucket, gram, keys) of items (key, text) to a folder of Parquet files, one folder for each bucket.

    A row holds a gram's keys in one batch of rows, each once: items of one key
    that follow each other are one posting, so the index may be coarser than the items searched. Batches
    are worked out where they are read and not shuffled; no task gets all rows of a frequent gram.
    """
    kinds = [f"{c}: {items.schema[c].dataType.simpleString()}" for c in key]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[int]] = {}
            rows = enumerate(zip(zip(*(batch[c].to_pylist() for c in key)), batch["_low"].to_pylist()))
            for _, run in groupby(rows, lambda row: row[1][0]):
                run = list(run)
                for gram in {t[i : i + 3] for _, (_, t) in run for i in range(len(t) - 1)}:
                    held.setdefault(gram, []).append(run[0][0])
            if held:
                ends = np.cumsum([0, *map(len, held.values())], dtype=np.int32)
                keys = batch.select(key).take(pa.array([i for at in held.values() for i in at])).to_struct_array()
                yield pa.record_batch([pa.array(held, pa.string()), pa.ListArray.from_arrays(pa.array(ends), keys)], ["gram", "keys"])

    flat = items.select(*key, F.lower(F.coalesce(text, F.lit(""))).alias("_low")).mapInArrow(post, f"gram string, keys array<struct<{', '.join(kinds)}>>")
    flat.withColumn("bucket", _bucket(F.col("gram"))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(index: DataFrame, items: DataFrame, key: list[str], needles: DataFrame, text: str = "text") -> DataFrame:
    """(needle, key, at): every item of items (key, text) that holds a needle, with the place of its first hit, from 0; case doesn't count.

    A needle's grams that no text has end its search. Else keys of the index that have all of
    its three rarest grams are candidates, and only texts of their items are looked at.
    The index holds the items' key or some of its columns. There is no cap: a needle of frequent grams has many candidates.

    Edge cases: needles are stripped and in lower case, equal ones are one; those
    below two characters, and null ones, find nothing; null texts hold nothing; an empty index or no needles give nothing.
    """
    asked = needles.select(F.lower(F.trim("needle")).alias("needle")).where("length(needle) >= 2").distinct()
    wanted = asked.withColumn("gram", F.explode(F.when(F.length("needle") == 2, F.array("needle")).otherwise(F.filter(grams(F.col("needle")), lambda g: F.length(g) == 3))))
    wanted = wanted.withColumn("bucket", _bucket(F.col("gram"))).withColumn("pair", F.length("gram") == 2)
    whole, pairs = wanted.where("NOT pair"), wanted.where("pair")
    posted = index.schema["keys"].dataType.elementType.names
    counts = index.join(whole.select("bucket", "gram").distinct(), ["bucket", "gram"]).groupBy("bucket", "gram").agg(F.sum(F.size("keys")).alias("rows"))
    by_need = Window.partitionBy("needle")
    ranked = whole.join(counts, ["bucket", "gram"], "left").withColumn("least", F.min(F.coalesce("rows", F.lit(0))).over(by_need)).where("least > 0")
    ranked = ranked.withColumn("nth", F.row_number().over(by_need.orderBy("rows", "gram"))).where(F.col("nth") <= RAREST)
    rare = ranked.withColumn("asked", F.max("nth").over(by_need)).select("needle", "bucket", "gram", "asked")
    both = index.join(rare, ["bucket", "gram"]).select("needle", "gram", "asked", F.inline("keys"))
    both = both.groupBy("needle", *posted).agg(F.size(F.collect_set("gram")).alias("held"), F.first("asked").alias("asked")).where("held = asked").select("needle", *posted)
    begun = index.join(pairs.select("needle", "bucket"), "bucket").where(F.substring("gram", 1, 2) == F.col("needle")).select("needle", F.inline("keys"))
    looked = both.unionByName(begun).groupBy(*posted).agg(F.collect_set("needle").alias("_needles"))
    texts = items.select(*key, F.lower(text).alias("_text")).join(looked, posted)
    return texts.select(*key, "_text", F.explode("_needles").alias("needle")).withColumn("at", F.instr("_text", F.col("needle")) - 1).where("at >= 0").select("needle", *key, "at")
