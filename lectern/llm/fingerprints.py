"""Bottom-k sketches of word-shingle hashes as document fingerprints."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
#: Shingle hashes are the upper 48 bits of xxhash64.
BITS = 48
#: Ranges of doc_id at most.
MOST_RANGES = 20_000


def _let(value, use) -> F.Column:
    """use(value) with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def word_hashes(text) -> F.Column:
    """xxhash64 of each word (parted by ``[\\x20\\x09-\\x0D]``); an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    )


def shingles(text, words: int = WORDS) -> F.Column:
    """48-bit hashes of all runs of ``words`` words; a shorter text is one shingle, a blank one none."""

    def of(h):
        n = F.size(h)
        runs = F.transform(h, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)]), 64 - BITS))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(n >= words, F.slice(runs, F.lit(1), F.greatest(n - (words - 1), F.lit(0)))).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _let(word_hashes(text), of)


def sketch(text, k: int = K, words: int = WORDS) -> F.Column:
    """The k smallest distinct shingle hashes, ascending (array of longs)."""
    return F.slice(F.sort_array(F.array_distinct(shingles(text, words))), 1, k)


def merge(a, b, k: int = K) -> F.Column:
    """The sketch of the union of two sketches' shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a, b, k: int = K) -> F.Column:
    """Estimated Jaccard resemblance, 0 to 1: the share of the union's sketch that both hold; 1 for two empty sketches."""
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    ))


def distinct_shingles(a, k: int = K) -> F.Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float((k - 1) * 2**BITS)) / F.element_at(a, k))


def containment(a, b, k: int = K) -> F.Column:
    """Estimated share of a's shingles that b holds, 0 to 1; 1 if a is empty."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a) -> F.Column:
    """A sketch as base64 of its 6-byte hashes; empty for an empty sketch."""
    packed = F.unhex(F.array_join(F.transform(a, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), ""))
    return F.translate(F.base64(packed), "\r\n", "")


def merge_sketches(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """(key, column): one sketch for each key from the sketches of its parts.

    Each part keeps its k smallest hashes of a key before the shuffle; equal
    hashes are dropped there too, so a hot key costs k rows for each task.
    """
    flat = df.select(key, F.explode(column).alias("_v")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_v"))
    return flat.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("_v")).alias(column))


def _neighbours(docs: DataFrame, rows_a_range: int) -> DataFrame:
    """docs (doc_id, text) with _hash (of the text) and _range: ranges of (doc_id descending, _hash), of which a greater one comes first.

    A doc_id that holds several cut points, and a null one, has ranges of its
    own by the hash of the text, as many as its rows need.
    """
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    # The cut points stand in the plan: beyond MOST_RANGES, ranges hold more rows instead (their windows spill).
    ranges = max(1, min(MOST_RANGES, math.ceil(counts.known / rows_a_range)))
    of_null = max(1, min(MOST_RANGES, math.ceil((counts.n - counts.known) / rows_a_range)))
    coarse = max(1, math.isqrt(ranges))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 20_000)).first()[0] or []
    times = sorted(Counter(cuts).items()) if ranges > 1 else []
    docs = docs.withColumn("_hash", F.xxhash64("text"))

    def by_hash(number) -> F.Column:
        """The text's place among ``number`` equal ranges of hashes, the last one first."""
        share = F.col("_hash").cast("double") / 2.0**64 + 0.5
        return number - 1 - F.least(F.floor(share * number), number - 1)

    if times:
        # Two short scans find the range: the group of cuts, then the cut in it.
        groups = [times[i : i + coarse] for i in range(0, len(times), coarse)]
        tops = F.array(*[F.lit(g[-1][0]) for g in groups])
        lists = F.array(*[F.array(*[F.lit(c) for c, _ in g]) for g in groups])
        g = F.size(F.filter(tops, lambda c: c < F.col("doc_id")))
        inner = F.size(F.filter(F.coalesce(F.get(lists, g), F.array().cast("array<bigint>")), lambda c: c < F.col("doc_id")))
        number = (g * coarse + inner).cast("long") * 2 * MOST_RANGES
        hot = {c: n for c, n in times if n > 1}
        if hot:
            rows = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x).cast("long") for cn in hot.items() for x in cn]), lambda c, _: c == F.col("doc_id"))), 0)
            number = number + F.coalesce(MOST_RANGES + by_hash(rows), F.lit(0))
    else:
        number = F.lit(0).cast("long")
    return docs.withColumn("_range", F.when(F.col("doc_id").isNull(), by_hash(F.lit(of_null)) - of_null).otherwise(number))


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = WORDS, rows_a_range: int = 500) -> DataFrame:
    """One row per document with the sketch of its text, of its edited text, and their likeness.

    docs: doc_id, text. Columns: doc_id, n_chars, edited_sha256, sketch,
    edited_sketch (arrays), near_edited, near_next. The edited text has the last
    floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document in descending doc_id; after the last comes the first.

    Documents are dealt into ranges of doc_id (cut points from approximate
    percentiles), and of the text's hash where very many rows have one doc_id or
    none: one shuffle of the texts. The first row of every range also goes, as a
    guest, to the end of the range before it (of the first range: to the last).
    No window spans the whole table.

    Edge cases: null texts count as empty; an empty text has an empty sketch,
    and two empty sketches have likeness 1; equal doc_ids stand in the order of
    their texts' hashes; a null doc_id comes last; a single document is its own next;
    other columns are left out; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = _neighbours(docs, rows_a_range)
    order = [F.desc_nulls_last("doc_id"), F.col("_hash"), F.col("text")]
    # The first doc_id and hash of every range, one row per range, and the range that its head row visits as a guest.
    heads = ranged.groupBy("_range").agg(F.max(F.struct("doc_id", F.bitwise_not("_hash").alias("hash"))).alias("_top"))
    tops = Window.orderBy(F.desc("_range"))
    all_ranges = tops.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    visits = heads.select(
        "_range", F.col("_top.doc_id").alias("_top"), F.bitwise_not("_top.hash").alias("_top_hash"),
        F.coalesce(F.lag("_range").over(tops), F.last("_range").over(all_ranges)).alias("_host"),
    )
    # Heads: of the rows with the range's largest doc_id and then least hash, the first in order.
    candidates = ranged.join(F.broadcast(visits), (ranged["_range"] == visits["_range"]) & ranged["doc_id"].eqNullSafe(visits["_top"]) & (ranged["_hash"] == visits["_top_hash"])).select(
        "doc_id", "text", "_hash", F.col("_host").alias("_range")
    )
    first = candidates.groupBy("_range").agg(F.min_by(F.struct("doc_id", "text", "_hash"), "text").alias("h"))
    guests = first.select("h.doc_id", "h.text", "h._hash", "_range", F.lit(True).alias("_guest"))
    dealt = ranged.withColumn("_guest", F.lit(False)).unionByName(guests)
    seen = Window.partitionBy("_range").orderBy("_guest", *order)
    paired = dealt.withColumn("_next", F.lead("text").over(seen)).withColumn("n_chars", F.length("text").cast("long"))
    paired = paired.withColumn("_edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"), F.expr("left(coalesce(_next, ''), cast(floor(n_chars / 3) as int))")))
    made = paired.select(
        "_range", "_guest", "doc_id", "text", "_hash", "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k, words).alias("sketch"),
        F.when(~F.col("_guest"), sketch(F.col("_edited"), k, words)).alias("edited_sketch"),
    )
    followed = made.withColumn("_after", F.lead("sketch").over(seen)).where("NOT _guest")
    return followed.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_after"), k).alias("near_next"),
    )
