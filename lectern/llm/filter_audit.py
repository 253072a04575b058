"""What each of several filters does, alone and in every order: masks of failures, counted once and reduced."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import of_groups, small_batches, stored, text_slices
from lectern.llm.words import BLANK, M1, mix

#: The filters and their bits in a mask.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"

#: Byte classes: bits of a table of 256.
CAPITAL, SYMBOL, LEAD = 1, 2, 4
CLASS = np.where((np.arange(256) & 0xC0) != 0x80, LEAD, 0).astype(np.uint8)
CLASS[0x41:0x5B] |= CAPITAL
CLASS[list(SYMBOLS)] |= SYMBOL

#: Bytes of words that are hashed at once, and from which on a word is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 1 << 12
_POWER = np.cumprod(np.full(PIECE + LONG_WORD, M1, np.uint64))
_INVERSE = np.cumprod(np.full(PIECE + LONG_WORD, pow(int(M1), -1, 1 << 64), np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, which never cross texts, and the number of words of each text."""
    solid = ~BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of prefix sums of a polynomial, a piece of the text at a time."""
    out = np.zeros(len(starts), np.uint64)
    for w in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[w] = int.from_bytes(blake2b(data[starts[w] : ends[w]], digest_size=8).digest(), "little")
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    lo = 0
    while lo < len(short):
        at = int(starts[short[lo]])
        hi = max(lo + 1, int(np.searchsorted(starts[short], at + PIECE)))
        own = short[lo:hi]
        piece = data[at : ends[own[-1]]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _POWER[: len(piece)], out=sums[1:])
        s, e = starts[own] - at, ends[own] - at
        out[own] = mix((sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether words that begin at one and two are equal in so many bytes."""
    out = np.ones(len(one), bool)
    to = np.cumsum(lengths)
    lo = 0
    while lo < len(one):
        hi = max(lo + 1, int(np.searchsorted(to, (to[lo - 1] if lo else 0) + PIECE, "right")))
        if hi == lo + 1:
            out[lo] = np.array_equal(data[one[lo] : one[lo] + lengths[lo]], data[two[lo] : two[lo] + lengths[lo]])
        else:
            n = lengths[lo:hi]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            unlike = data[np.repeat(one[lo:hi], n) + within] != data[np.repeat(two[lo:hi], n) + within]
            out[lo:hi] = ~np.logical_or.reduceat(unlike, np.cumsum(n) - n)
        lo = hi
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each text: hashes sorted within texts, and equal neighbours compared byte by byte.

    A text in which unequal words have equal hashes is counted anew from its words.
    ``keys`` replaces the hashes, for tests.
    """
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    keys = hashes(data, starts, ends) if keys is None else keys
    order = np.argsort(mix(keys ^ mix((text + 1).astype(np.uint64) * M1)))
    key, t = keys[order], text[order]
    lengths = (ends - starts)[order]
    same = np.flatnonzero((key[1:] == key[:-1]) & (t[1:] == t[:-1]))
    like = lengths[same + 1] == lengths[same]
    checked = same[like]
    like[like] = _same_bytes(data, starts[order[checked]], starts[order[checked + 1]], lengths[checked])
    out = counts - np.bincount(t[same], minlength=len(counts))
    # Hashes of two texts that meet in the sort could part equal words; so could unequal words of one hash.
    mixed = key[1:] != key[:-1]
    meet = mixed | (t[1:] != t[:-1])
    sorted_by = mix(key ^ mix((t + 1).astype(np.uint64) * M1))
    clash = np.flatnonzero(meet & (sorted_by[1:] == sorted_by[:-1]))
    for x in np.unique(np.concatenate((t[same[~like]], t[clash], t[clash + 1]))).tolist():
        own = np.flatnonzero(text == x)
        out[x] = len({data[s:e].tobytes() for s, e in zip(starts[own].tolist(), ends[own].tolist())})
    return out


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits A to D of each text."""
    kinds = CLASS[data]

    def of(kind: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum((kinds & kind) != 0, out=sums[1:])
        return np.diff(sums[offsets])

    starts, ends, words = words_of(data, offsets)
    distinct = distinct_words(data, starts, ends, words)
    failed = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * of(CAPITAL) > MOST_CAPITALS * of(LEAD), of(SYMBOL) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of docs (doc_id, text, source): one bit for each filter that it fails.

    A: under 50 words; B: under 65% of words distinct; C: over 5% capitals A-Z;
    D: one of ``#$%&*|``; E: the text of a smaller doc_id, wherever that stands.
    Texts are scanned where they lie; E takes the SHA-256 of texts, whose groups
    are counted per task and salt before they meet.

    Edge cases: null text counts as empty (fails A only, and E if an empty text
    has a smaller doc_id), null source is the empty part; a null doc_id is
    neither smaller nor larger than others; rows of one doc_id aren't copies of
    each other for E; other columns are left out; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in text_slices(batch, "text", 1 << 21):
                yield pa.record_batch([some["doc_id"], some["part"], some["digest"], pa.array(failures(data, offsets))], ["doc_id", "part", "digest", "own"])

    scanned = stored(rows.mapInArrow(scan, f"doc_id {kind}, part string, digest binary, own int").withColumn("row", F.monotonically_increasing_id()))
    grouped = of_groups(scanned, "digest", "doc_id", "row")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return grouped.select("doc_id", "part", (F.col("own") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each mask, and those labelled of good quality or toxic. At most 32 rows a part.

    A doc_id of several labels is good or toxic if one of them says so. Rows without doc_id have no label.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # Rows without doc_id are counted beside the join: in it they would meet in one task.
    known = masks.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    none = masks.where("doc_id IS NULL").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    return known.unionByName(none).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of filters and step, from mask counts: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The at most 32 masks of a part are reduced once to 32 sums: what passes
    every filter of a set. A step then is a difference of two of them. shapley
    is what a filter removes, summed over all orders: of k filters that a row
    fails, each comes first in 120 / k orders. Zeros have rows too; without
    counts there is no part.
    """
    every = math.factorial(len(filters))
    sets = f"sequence(0, {(1 << len(filters)) - 1})"

    def passing(value: str) -> Column:
        return F.expr(f"transform({sets}, z -> aggregate(filter(masks, m -> (m.mask & z) = 0), 0L, (a, m) -> a + m.{value}))")

    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    parts = masks.select(
        "part", passing("n").alias("rows"), passing("good").alias("good"), passing("toxic").alias("toxic"),
        F.expr(f"transform({sets}, z -> aggregate(filter(masks, m -> m.mask = z), 0L, (a, m) -> a + m.n))").alias("only"),
        F.expr(f"transform({sets}, z -> aggregate(filter(masks, m -> (m.mask & z) <> 0), 0L, (a, m) -> a + m.n * CAST({every} / bit_count(m.mask) AS BIGINT)))").alias("shares"),
    )
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    each = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bit = "shiftleft(1, locate(substring(filter_order, {}, 1), '" + filters + "') - 1)"
    placed = each.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(f"aggregate(sequence(0, step - 1), 0, (a, i) -> a | if(i = 0, 0, {bit.format('i')}))"))
    return placed.select(
        "part", "filter_order", "step",
        F.expr("rows[before | own]").alias("kept"),
        F.expr("rows[before] - rows[before | own]").alias("removed"),
        F.expr("rows[0] - rows[own] - (rows[before] - rows[before | own])").alias("redundant"),
        F.expr("only[own]").alias("unique_fails"),
        F.expr("good[before] - good[before | own]").alias("good_lost"),
        F.expr("toxic[before] - toxic[before | own]").alias("toxic_lost"),
        F.expr("shares[own]").alias("shapley"),
    )
