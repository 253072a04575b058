"""Removal of long repeated byte strings with suffix arrays built by two-stage sorting.

A string of ``window`` bytes that occurs twice chooses the same anchor in both
places. Around an anchor, ``window`` bytes long windows fall into RANGES by how
far left they reach; all windows of one range share a core of bytes. Rows that
agree on anchor, range and core meet, and only the two margins beside the core
still differ: they are joined around a token that stands for the core, and a
suffix array over these strings shows which windows stand in two places. Where
very many unlike margins share a core, longer cores part them: a window reaches
half a margin at least to the left or to the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.anchors import anchors, gram_hashes
from lectern.llm.common import group_starts, passing, small_batches, sorted_groups, stored

WINDOW, GRAM, RANGES = 400, 32, 4
#: Strings that are sorted together at most.
MOST = 4_000
#: Tasks that the rows of one string are dealt to.
DEAL = 8
#: Bytes that no UTF-8 text holds: the lead of a core's token, and the end of a string.
TOKEN, END = 0xFF, 0xFE
TOKEN_BYTES = 4


# -- suffix arrays ------------------------------------------------------------------


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of a byte string, in order to ``depth`` bytes at least.

    Suffixes smaller than their successor are sorted directly by their first
    ``depth`` bytes. The others are induced: buckets of first bytes are
    scanned in ascending order, and each suffix found there places the suffix
    before it, if that is a larger one, at the next free front place of its bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # smaller[i]: suffix i < suffix i + 1. Runs of one byte take after what follows them; the last suffix is larger.
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, bool)
    if len(differs):
        nearest = np.searchsorted(differs, np.arange(n - 1))
        has = nearest < len(differs)
        at = differs[np.minimum(nearest, len(differs) - 1)]
        smaller[:-1] = has & (text[at] < text[at + 1])
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    direct = np.flatnonzero(smaller)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    front = ends - counts
    sa = np.full(n, -1, np.int64)
    small_counts = np.bincount(text[direct], minlength=256)
    tails = ends - small_counts
    done = 0
    for c in np.flatnonzero(small_counts):
        sa[tails[c] : ends[c]] = direct[done : done + small_counts[c]]
        done += small_counts[c]
    larger = ~smaller

    def place(found: np.ndarray) -> None:
        """Puts the larger predecessors of suffixes, in this order, at the fronts of their buckets."""
        before = found[found > 0] - 1
        before = before[larger[before]]
        own = text[before]
        order = np.argsort(own, kind="stable")
        before, own = before[order], own[order]
        firsts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
        for lo, hi in zip(firsts, [*firsts[1:], len(own)]):
            c = own[lo]
            sa[front[c] : front[c] + hi - lo] = before[lo:hi]
            front[c] += hi - lo

    # The last suffix is followed by nothing, which sorts before all: it is the first that is induced.
    last = int(text[-1])
    sa[front[last]] = n - 1
    front[last] += 1
    for c in np.flatnonzero(counts):
        at = ends[c] - counts[c]
        while at < front[c]:  # each scan may place more suffixes of the same bucket, behind those it reads
            stop = front[c]
            place(sa[at:stop])
            at = stop
        place(sa[tails[c] : ends[c]])
    return sa


def adjacent_prefixes(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in sa, up to ``depth``; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.full(depth, END, np.uint8))), depth)
    for lo in range(1, len(sa), 100_000):
        hi = min(len(sa), lo + 100_000)
        unlike = view[sa[lo:hi]] != view[sa[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(unlike.any(1), unlike.argmax(1), depth)
    return out


def repeated_windows(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], margin: int) -> list[np.ndarray]:
    """For each string of margins the numbers t for which its window of t left and margin - t right bytes is in another string of its group."""
    parts, starts, at = [], [], 0
    for g, a, b in zip(groups.tolist(), lefts, rights):
        starts.append(at)
        token = bytes((TOKEN, g // 40_000, g // 200 % 200, g % 200))
        parts.append(a + token + b + bytes((END,)))
        at += len(parts[-1])
    text = np.frombuffer(b"".join(parts), np.uint8)
    need = margin + TOKEN_BYTES
    sa = two_stage(text, need)
    starts_a = np.array(starts)
    left_a, right_a = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    owner = np.repeat(np.arange(len(parts)), np.diff(np.append(starts_a, len(text))))
    reach = left_a[owner] - (np.arange(len(text)) - starts_a[owner])  # left bytes from here on
    useful = (reach >= 0) & (reach <= margin) & (right_a[owner] >= margin - reach)
    kept = sa[useful[sa]]  # order is kept, and equal windows stay next to each other
    same = adjacent_prefixes(text, kept, need) >= need
    hit = np.zeros(len(kept), bool)
    hit[same] = True
    hit[:-1] |= same[1:]
    found = kept[hit]
    out: list[list[int]] = [[] for _ in parts]
    for i, t in zip(owner[found].tolist(), reach[found].tolist()):
        out[i].append(t)
    return [np.sort(np.array(x, np.int64)) for x in out]


# -- spans ----------------------------------------------------------------------------


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


def window_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows from hashes of their two overlapping halves of a power of two."""
    size = 1 << (window.bit_length() - 1)
    h = gram_hashes(data, size)
    return h[: len(data) - window + 1] * np.uint64(0x9E3779B97F4A7C15) ^ h[window - size :]


def equal_windows(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's windows in an order that puts equal ones together, ascending, and whether each equals the one before it.

    Hashes only make the order: neighbours are compared byte by byte, and if unlike ones share a hash, bytes order them too.
    """
    h, view = window_hashes(data, window), np.lib.stride_tricks.sliding_window_view(data, window)

    def compared(order: np.ndarray) -> np.ndarray:
        same = np.zeros(len(order), bool)
        same[1:] = h[order[1:]] == h[order[:-1]]
        alike = np.flatnonzero(same)
        for lo in range(0, len(alike), 20_000):
            some = alike[lo : lo + 20_000]
            same[some] = (view[order[some]] == view[order[some - 1]]).all(1)
        return same

    order = np.argsort(h, kind="stable")
    same = compared(order)
    if (~same[1:] & (h[order[1:]] == h[order[:-1]])).any():
        order = np.array(sorted(range(len(h)), key=lambda i: (h[i], view[i].tobytes())))
        same = compared(order)
    return order, same


def find_anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions and hashes of a text's anchors, and spans that the text repeats by itself.

    Where short periods make anchors dense, the windows that the text holds
    several times become spans at once, and only the first of each chooses an anchor.
    """
    h = gram_hashes(data, gram)
    w = window - gram + 1
    at = anchors(h, w)
    if len(at) * w <= 16 * len(data):
        return at, h[at], []
    order, same = equal_windows(data, window)
    first, several = np.ones(len(order), bool), np.zeros(len(order), bool)
    first[order] = ~same
    several[order] = same
    several[order[:-1]] |= same[1:]
    again = np.flatnonzero(several)
    at = anchors(h, w, first)
    return at, h[at], list(zip(*(x.tolist() for x in merged(again, again + window))))


def rows_of_anchor(data: bytes, at: int, window: int, gram: int, ranges: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(range, hash of core, left margin, right margin) of an anchor's windows that fit into the text."""
    margin = (window - gram) // ranges
    for j in range(ranges):
        lo, hi = at - margin * j, at + gram + margin * (ranges - 1 - j)
        if lo < 0 or hi > len(data):
            continue
        left, right = data[max(0, lo - margin) : lo], data[hi : hi + margin]
        if len(left) + len(right) >= margin:
            yield j, xxhash.xxh3_128_digest(data[lo:hi] + bytes((j,))), left, right


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, ranges: int = RANGES, most: int = MOST) -> DataFrame:
    """(key, copies, starts, ends): byte spans of each distinct text that stand elsewhere too.

    key is the 16-byte md5 of the text. A text with copies is one span, if it
    has a window at all. Only texts with a repeated anchor appear, or copies.
    A core with more than ``most`` unlike margins isn't sorted in one task: its
    strings meet under longer cores (see _longer_cores), until each has ``most`` at most or no margin is left.
    """
    if (window - gram) % ranges:
        raise ValueError("window - gram must be a multiple of ranges")
    margin = (window - gram) // ranges
    small_batches(docs.sparkSession)
    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") >= window)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, hashes, ends = [], [], [], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"]):
                at, h, own = find_anchors(np.frombuffer(text.as_buffer(), np.uint8), window, gram)
                keys += [key] * (len(at) + len(own))
                ats += [at, np.array([a for a, _ in own], np.int64)]
                hashes += [h, np.zeros(len(own), np.uint64)]
                ends += [np.zeros(len(at), np.int64), np.array([b for _, b in own], np.int64)]
            if keys:
                columns = [np.concatenate(hashes).view(np.int64), pa.array(keys, pa.binary()), np.concatenate(ats).astype(np.int32), np.concatenate(ends).astype(np.int32)]
                yield from pa.table([pa.array(c) for c in columns], ["h", "key", "at", "end"]).to_batches(50_000)

    both = stored(texts.mapInArrow(choose, "h long, key binary, at int, end int"))
    chosen = both.where("end = 0").drop("end")
    alone = both.where("end > 0").select("key", F.col("at").alias("start"), "end")
    often = chosen.groupBy("h").agg(F.min(F.struct("key", "at")).alias("a"), F.max(F.struct("key", "at")).alias("b")).where("a <> b").select("h")
    # The places of a frequent anchor are dealt to 16 parts.
    parts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s")
    places = chosen.withColumn("_s", F.pmod(F.xxhash64("key", "at"), F.lit(16)).cast("int")).join(often.select("h", parts), ["h", "_s"]).groupBy("key").agg(F.collect_set("at").alias("ats"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch["key"], pa.array([squeeze.compress(t.as_buffer()) for t in batch["text"]], pa.binary())], ["key", "z"])

    packed = texts.mapInArrow(pack, "key binary, z binary")
    once = packed.groupBy("key").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        names = ["core", "mid", "left", "right", "key", "at"]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            for key, z, ats in zip(batch["key"].to_pylist(), batch["z"].to_pylist(), batch["ats"].to_pylist()):
                data = expand.decompress(z)
                for at in sorted(ats):
                    for j, core, left, right in rows_of_anchor(data, at, window, gram, ranges):
                        mid = xxhash.xxh3_128_digest(core + left + bytes((TOKEN,)) + right)
                        out.append((core, mid, left, right, key, at - margin * j))
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    # at: where the row's core begins.
    rows = stored(once.join(places, "key").select("key", "z", "ats").mapInArrow(cut, "core binary, mid binary, left binary, right binary, key binary, at int"))
    level = rows.select("mid", F.lit(0).alias("base"), "core", F.col("mid").alias("string"), "left", "right")
    found, strings = _of_level(level, margin, most)
    hits = found
    level = strings.where(f"strings > {most}").select(F.col("string").alias("mid"), F.lit(0).alias("base"), "core", "left", "right")
    while margin and not level.isEmpty():
        level, margin = stored(_longer_cores(level, margin)), margin // 2
        found, strings = _of_level(level, margin, most)
        # Many margins may share what is left of them at this level: they are dealt to DEAL parts.
        hits = hits.union(_dealt(level.select("string", "mid", "base"), found.withColumnRenamed("mid", "string"), "string", "mid").select("mid", (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi")))
        many = strings.where(f"strings > {most}").select("core", "string")
        level = level.join(many, ["core", "string"], "left_semi").drop("string")
    hit = _dealt(rows.select("mid", "key", "at"), hits, "mid", "key", "at")
    spans = hit.select("key", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + window).alias("end")).union(alone)
    per_text = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return per_text


def _of_level(level: DataFrame, margin: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Repeated windows (mid, lo, hi) of strings whose cores have ``most`` unlike ones at most, and of strings that stand there twice; and the strings of cores with several.

    level: core, string (a hash of core and margins), left, right. A window is
    known by its number of left bytes; lo to hi are such numbers.
    """
    strings = level.groupBy("core", "string").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    cores = strings.groupBy("core").agg(F.count(F.lit(1)).alias("strings"), F.sum("n").alias("all")).where("all > 1")
    strings = stored(strings.join(cores, "core"))
    whole = strings.where("n > 1").select(F.col("string").alias("mid"), F.greatest(F.lit(0), margin - F.octet_length("right")).alias("lo"), F.least(F.lit(margin), F.octet_length("left")).alias("hi"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["core"], MOST):
            firsts = group_starts(table, ["core"])
            number = np.zeros(table.num_rows, np.int64)
            number[firsts] = 1
            number = np.cumsum(number) - 1
            lefts, rights, strings = (table[c].to_pylist() for c in ("left", "right", "string"))
            out: list[tuple] = []
            for string, ts in zip(strings, repeated_windows(number, lefts, rights, margin)):
                if len(ts):
                    breaks = np.flatnonzero(np.diff(ts) > 1)
                    out += [(string, int(lo), int(hi)) for lo, hi in zip(ts[np.concatenate(([0], breaks + 1))], ts[np.concatenate((breaks, [len(ts) - 1]))])]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), [pa.binary(), pa.int32(), pa.int32()])], ["mid", "lo", "hi"])

    some = strings.where(f"strings > 1 AND strings <= {most}").select("core", "string", "left", "right").repartition("core").sortWithinPartitions("core")
    return whole.union(some.mapInArrow(sort, "mid binary, lo int, hi int")), strings


def _longer_cores(level: DataFrame, margin: int) -> DataFrame:
    """Each string of level (mid, base, core, left, right) under two longer cores, with margins of half the size.

    Of a window's ``margin`` bytes beside the core, the left or the right ones
    are half or more: the ones next to the core join it on that side. base is the
    number of left bytes that have joined the core. Windows of both halves are found twice.
    """
    rest = margin // 2
    taken = margin - rest
    left, right = F.octet_length("left"), F.octet_length("right")
    ways = (
        (left >= taken, "L", F.substring(F.col("left"), -taken, taken), F.expr(f"substring(left, 1, octet_length(left) - {taken})"), F.substring(F.col("right"), 1, rest), F.col("base") + taken),
        (right >= taken, "R", F.substring(F.col("right"), 1, taken), F.expr(f"substring(left, greatest(octet_length(left) - {rest}, 0) + 1, {rest})"), F.substring(F.col("right"), taken + 1, rest), F.col("base")),
    )
    parts = []
    for fits, side, joined, a, b, base in ways:
        core = F.unhex(F.md5(F.concat("core", F.lit(side).cast("binary"), joined)))
        parts.append(level.where(fits).select("mid", base.alias("base"), core.alias("core"), a.alias("left"), b.alias("right")))
    both = parts[0].union(parts[1]).where(F.octet_length("left") + F.octet_length("right") >= rest)
    string = F.unhex(F.md5(F.concat("core", "left", F.lit(bytes((TOKEN,))), "right")))
    return both.select("mid", "base", "core", string.alias("string"), "left", "right")


def _dealt(rows: DataFrame, hits: DataFrame, key: str, *deal: str) -> DataFrame:
    """rows joined with hits; the rows of one key go to DEAL tasks, its hits to all of them."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*deal), F.lit(DEAL)).cast("int"))
    return salted.join(hits.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))), [key, "_s"]).drop("_s")


@passing("doc_id", "text")
def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, ranges: int = RANGES, most: int = MOST) -> DataFrame:
    """docs (doc_id, text, more) with n_bytes, n_removed, n_spans, spans, kept (binary) and kept_sha256.

    A byte goes if a string of ``window`` bytes over it also starts anywhere
    else, in its own document or another; strings are judged on the input.
    spans are the maximal removed runs, half-open byte positions.

    Edge cases: a null text counts as empty; texts below ``window`` bytes lose
    nothing; copies of a text that has a window lose all of it; rows with equal
    doc_id are documents of their own; removal may split a code point only
    where two different ones share bytes, so kept is binary; other columns pass
    through, but the names added here are replaced; an empty table stays empty.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.withColumn("_key", F.unhex(F.md5(text))).withColumn("n_bytes", F.octet_length(text).cast("long"))
    copies = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    spans = repeated_spans(docs.select("text"), window, gram, ranges, most).withColumnRenamed("key", "_key")
    known = stored(spans.join(copies, "_key", "full"))

    @F.pandas_udf("n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, given in batches:
            out = []
            for data, some in zip(texts, given):
                starts, ends = merged(np.array([s["start"] for s in some], np.int64), np.array([s["end"] for s in some], np.int64))
                kept, last = [], 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                rest = b"".join(kept)
                out.append((len(data) - len(rest), len(starts), [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)], rest, hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    # Rows of one text are dealt to 16 parts; what is known of the text goes to each.
    dealt = keyed.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    joined = dealt.join(known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["_key", "_s"], "left").withColumn("_spans", F.when((F.col("_n") > 1) & (F.col("n_bytes") >= window), every).otherwise(F.coalesce("spans", none)))
    made = joined.drop("spans").withColumn("_made", apply(text, F.col("_spans")))
    return made.select(*docs.columns, "n_bytes", "_made.*")
