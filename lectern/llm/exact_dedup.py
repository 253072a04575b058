"""Exact duplicates by refinement: equal length, then equal beginning, then equal text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import of_groups, stored

#: Code points of a text's beginning that the second step compares.
PREFIX = 256
#: log2 of the bits of a set of surviving keys: 2^22 bits are 2^16 longs, whatever the table's size.
BITS = 22


def normalised(text) -> Column:
    """The text with one space for each run of ``[\\x20\\x09-\\x0D]``; null counts as empty. Lone spaces stay as they are and cost nothing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits))


def _key_set(keys: DataFrame, bits: int) -> DataFrame:
    """(word, set): a set of keys (column bit) as 2^bits bits in longs; always the same number of rows, whatever the keys."""
    words = keys.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("some"))
    every = keys.sparkSession.range(1 << max(0, bits - 6)).select(F.col("id").alias("word"))
    return every.join(words, "word", "left").select("word", F.coalesce("some", F.lit(0).cast("long")).alias("set"))


def _in_set(rows: DataFrame, bit: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a boolean ``name``: whether the bit is in the set; the broadcast side has a fixed size."""
    sized = rows.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6))
    found = sized.join(F.broadcast(keys), "word", "left")
    return found.withColumn(name, F.expr("(coalesce(set, 0L) & shiftleft(1L, cast(bit & 63 AS int))) <> 0")).drop("word", "bit", "set")


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), hash_all: bool = False, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_hash, and the columns named in carry.

    Texts are equal when their ``normalised`` forms are. The refinement:
    a first scan keeps length and hash of the beginning of every text. Lengths
    that stand once are done, then (length, beginning) pairs that stand once.
    A second scan hashes whole texts (SHA-256) only where a row's pair still
    stands twice; those hashes form the groups. Texts never leave their task:
    what is shuffled are lengths and hashes. Which keys survive is told to the
    second scan by a bit set of fixed size (2^bits bits); where it fills up, more
    texts are hashed than need be and the groups stay the same.

    Hot groups: counts and minima are taken per task, then per (group, 1 of 256
    salts), so no task gets more than a 256th of a group's rows.

    text_hash is null for texts that are alone, unless hash_all asks for the
    hash of every text. Of equal texts the row with the least doc_id stays; of
    several such rows exactly one.

    Edge cases: null text counts as empty, and empty texts are equal; a null
    doc_id is larger than all others, so it stays only where all of a group are
    null (keep_id is null then); texts of any length are taken whole; columns not
    in carry are left out, a carried one that has a result's name is replaced; an
    empty table gives an empty result.
    """
    made = ("doc_id", "keep_id", "group_size", "kept", "text_hash")
    names = [c for c in carry if c not in made]
    given = F.struct(F.col("doc_id"), *(F.col(f"`{c}`") for c in names)).alias("given")
    texts = docs.select(given, normalised(F.col("text")).alias("text"))
    sized = texts.withColumn("n", F.octet_length("text").cast("long")).withColumn("start", F.xxhash64("n", F.substring("text", 1, prefix)))
    # First scan: narrow rows. A length below 2^bits has a bit of its own.
    narrow = stored(sized.select("n", "start"))
    lengths = narrow.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(_bit(F.col("n"), bits).alias("bit"))
    long_enough = _in_set(narrow, _bit(F.col("n"), bits), _key_set(lengths, bits), "shared").where("shared")
    starts = long_enough.groupBy("n", "start").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(_bit(F.col("start"), bits).alias("bit"))
    starts = stored(_key_set(starts, bits))
    # Second scan: whole texts are hashed where length and beginning stand twice.
    marked = _in_set(sized, _bit(F.col("start"), bits), starts, "survives")
    whole = F.sha2(F.col("text").cast("binary"), 256)
    hashed = marked.select("given", "survives", (whole if hash_all else F.when(F.col("survives"), whole)).alias("text_hash"))
    rows = stored(hashed.withColumn("row", F.monotonically_increasing_id()).withColumn("first", F.struct(F.col("given.doc_id").isNull(), F.col("given.doc_id").alias("doc_id"), F.col("row"))))
    grouped = of_groups(rows.where("survives"), "text_hash", "first", "row")
    alone = rows.where("NOT survives").withColumn("group_size", F.lit(1).cast("long")).withColumn("least", F.col("first"))
    return grouped.unionByName(alone).select(
        "given.*", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("least.row")).alias("kept"),
        (F.col("text_hash") if hash_all else F.when(F.col("group_size") > 1, F.col("text_hash"))).alias("text_hash"),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; edge cases are those of exact_duplicates."""
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all_columns"))
    return exact_duplicates(packed, carry=("all_columns",), **options).where("kept").select("all_columns.*")
