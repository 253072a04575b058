"""Language identification: bit-sliced Bloom filters of n-grams, popcounts corrected for false positives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import passing, small_batches

UNKNOWN = "und"
SPACE = 32
#: A language's filter holds n-grams with at least this share of its own n-grams, so a hundred thousand at most ...
MIN_SHARE = 1e-5
#: ... and at least this part of the largest share that any language has of the n-gram.
MIN_PART = 0.2
ORDERS = (3, 4)
#: Texts are joined to about this many code points at a time; a longer text is taken alone.
MOST_CHARS = 500_000


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside words, and how many each text has.

    Texts are lower-cased and all but letters become spaces. An n-gram lies in
    one word; its first and last place may be the space beside the word.
    """
    cps = points(" " + " ".join(t.lower() for t in texts) + " ")
    is_letter = letters()[cps]
    cps = np.where(is_letter, cps, SPACE).astype(np.uint64)
    mixed = cps * np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum([1 + len(points(t.lower())) for t in texts])  # place of the space after each text
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for n in ORDERS:
        m = len(cps) - n + 1
        if m <= 0:
            continue
        inside = is_letter[1 : 1 + m].copy()
        for i in range(2, n - 1):
            inside &= is_letter[i : i + m]
        at = np.flatnonzero(inside)
        h = mixed[at] + np.uint64(n)
        for i in range(1, n):
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[at + i]
        h ^= h >> np.uint64(32)
        cuts = np.searchsorted(at, ends)
        counts_n = np.diff(np.concatenate(([0], cuts)))
        hashes.append((h, cuts))
        counts += counts_n
    # Interleave the orders by text, so that a text's n-grams stand together.
    out = np.empty(int(counts.sum()), np.uint64)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    used = np.zeros(len(texts), np.int64)
    for h, cuts in hashes:
        before = np.concatenate(([0], cuts[:-1]))
        own = cuts - before
        shift = np.repeat(starts + used - before, own)
        out[np.arange(int(own.sum())) + shift] = h[: int(own.sum())]
        used += own
    return out, counts


@dataclass
class Filters:
    """slots[i, l // 64] has bit l % 64 set if language l's Bloom filter has bit i set: one read gives 64 languages."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    usual: int

    @classmethod
    def of(cls, langs: list[str], grams_of: list[np.ndarray], usual: int = 0) -> Filters:
        most = max([1024, *(len(g) for g in grams_of)])
        bits = int(np.ceil(np.log2(most))) + 4  # about 16 bits or more for each n-gram
        slots = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), np.uint64)
        for lang, g in enumerate(grams_of):
            for at in places(g, bits):
                np.bitwise_or.at(slots[:, lang // 64], at, np.uint64(1 << lang % 64))
        full = np.array([np.count_nonzero(slots[:, lang // 64] & np.uint64(1 << lang % 64)) / len(slots) for lang in range(len(langs))])
        return cls(langs, slots, full**2, usual)

    def masks(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the bitmask of those of 64 languages (from 64 * word on) whose filters hold it."""
        first, second = places(hashes, int(np.log2(len(self.slots))))
        return self.slots[first, word] & self.slots[second, word]

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores = [], []
        for part in _parts(texts):
            given = [t or "" for t in part]
            hashes, counts = grams(given)
            starts = np.concatenate(([0], np.cumsum(counts)))
            seen = np.zeros((len(part), len(self.langs)))
            for lang in range(len(self.langs)):
                if lang % 64 == 0:
                    masks = self.masks(hashes, lang // 64)
                ones = np.concatenate(([0], np.cumsum((masks >> np.uint64(lang % 64)) & np.uint64(1), dtype=np.int64)))
                seen[:, lang] = ones[starts[1:]] - ones[starts[:-1]]
            # Of n n-grams, about n * false_rate are in a filter by chance.
            true = np.maximum(0, (seen - counts[:, None] * self.false_rate) / (1 - self.false_rate))
            total = true.sum(1)
            best = np.where(total > 0, true.argmax(1) if len(self.langs) else 0, self.usual)
            score = np.where(total > 0, true.max(1, initial=0) / np.maximum(total, 1e-300), 0.0)
            none = (counts == 0) | (len(self.langs) == 0)
            langs += [UNKNOWN if n else self.langs[b] for n, b in zip(none, best)]
            scores += [0.0 if n else float(s) for n, s in zip(none, score)]
        return langs, scores


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of each n-gram."""
    top = np.uint64(64 - bits)
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> top, (hashes * np.uint64(0xD6E8FEB86659FD93)) >> top


def _parts(texts: list) -> Iterator[list]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= MOST_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_a_language: int = 4000) -> Filters:
    """Filters from about ``docs_a_language`` rows of each language (a documented bound; rows are chosen by the key's hash).

    N-grams are counted in the tasks and summed over all of them; what comes to
    the driver is the n-grams of at least MIN_SHARE of a language, so at most
    1 / MIN_SHARE for each.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters.of([], [])
    number = {name: i for i, name in enumerate(langs)}
    part = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, docs_a_language / n)))), F.col(lang)), F.lit(0.0))
    few = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < part * 1_000_003).select(text, lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([number.get(x, -1) for x in batch[1].to_pylist()])
            texts = batch[0].to_pylist()
            for i in np.unique(names[names >= 0]):
                for part in _parts([texts[j] for j in np.flatnonzero(names == i)]):
                    g, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(g), i, np.int32)), pa.array(g.view(np.int64)), pa.array(n)], ["l", "g", "n"])

    counts = few.mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))
    often = counts.join(F.broadcast(totals), "l").where(F.col("n") >= F.col("total") * MIN_SHARE)  # totals: a row for each language
    found = often.select("l", "g", (F.col("n") / F.col("total")).alias("share")).toPandas()
    found["most"] = found.groupby("g")["share"].transform("max")
    found = found[found.share >= MIN_PART * found.most]
    grams_of = [found[found.l == i].g.to_numpy(np.int64).view(np.uint64) for i in range(len(langs))]
    return Filters.of(langs, grams_of, number[max(sizes, key=sizes.get)])


@passing("doc_id", "text", "held_out")
def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    score is the winning language's share of all languages' corrected counts.

    Edge cases: a text that is null or has no letter is ``und`` with score 0; a
    text with letters but none of any filter's n-grams gets the language with
    the most labelled rows and score 0; ties go to the first language by name;
    with no language learned every text is ``und``; equal texts get equal
    answers; other columns pass through, but the names added here are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.identify([None if pd.isna(t) else t for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    docs = docs.drop("lang_pred", "score")
    return docs.withColumn("_said", run(text)).select(*docs.columns, "_said.*")
