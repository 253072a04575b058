"""A generalised additive model with pairwise interactions that scores the quality of texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import passing, small_batches

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "stop_mark", "loud_mark", "symbol", "space", "non_ascii",
    "lines_a_word", "distinct_words", "repeated_word", "repeated_line", "longest_word", "short_words", "capital_words", "top_word", "bare_symbol_words", "words_a_stop",
)
UPPER, LOWER, DIGIT, STOP, LOUD, SYMBOL, BLANK, NEWLINE, OTHER = range(9)
#: Threshold on the score from which a text counts as good.
GOOD = 0.7


@cache
def kinds() -> np.ndarray:
    """Kind of each code point."""

    def kind(i: int) -> int:
        c = chr(i)
        if c == "\n":
            return NEWLINE
        if c.isspace():
            return BLANK
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        if c.isdigit():
            return DIGIT
        return STOP if c in ".,;:'\"()-?¿" else LOUD if c in "!¡" else SYMBOL if c.isprintable() else OTHER

    return np.fromiter(map(kind, range(0x110000)), np.uint8, 0x110000)


def features(text: str | None) -> list[float]:
    """The model's features of a whole text; an empty or null text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cps)
    by = np.bincount(kinds()[cps], minlength=9)
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    shown = max(1, n - int(by[BLANK]) - int(by[NEWLINE]))
    longest, short, capital, bare = 0, 0, 0, 0
    for x, c in counts.items():
        size = len(x)
        longest = max(longest, size)
        if size <= 3:
            short += c
        if x[0].isupper():
            capital += c
        if not x[0].isalnum() and not x[-1].isalnum() and not any(map(str.isalnum, x)):
            bare += c
    return [
        math.log1p(n), math.log1p(len(words)), shown / w, by[UPPER] / shown, by[DIGIT] / shown, by[STOP] / shown, by[LOUD] / shown, by[SYMBOL] / shown,
        by[BLANK] / n, np.count_nonzero(cps > 127) / n, by[NEWLINE] / w, len(counts) / w, sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(longest), short / w, capital / w,
        max(counts.values(), default=0) / w, bare / w, math.log1p(len(words) / (1 + by[STOP])),
    ]


@dataclass
class Model:
    """Score = sigmoid(base + sum of tables[f][bin of f] + sum of pair tables[bin of f, bin of g])."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for f, table in enumerate(self.tables):
            out += table[b[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            out += table[b[:, f], b[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(x))))


def fit(x: np.ndarray, y: np.ndarray, most_bins: int = 48, rounds: int = 250, pair_rounds: int = 80, most_pairs: int = 8, rate: float = 0.08) -> Model:
    """Cyclic boosting: each round takes every feature in turn and adds a small tree of at most four leaves to its table.

    Afterwards the pairs whose four quadrants explain most of what is left are
    boosted in the same way, with two cuts on each.
    """
    if not len(y):
        return Model([], 0.0, [])
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, most_bins + 1)[1:-1])) for f in range(x.shape[1])]
    model = Model(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    b = model.bins(x)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-raw))
            step = rate * _tree(np.bincount(b[:, f], y - p, len(table)), np.bincount(b[:, f], p * (1 - p), len(table)))
            table += step
            raw += step[b[:, f]]
    p = 1 / (1 + np.exp(-raw))
    gains = []
    for f, g in combinations(range(len(cuts)), 2):
        grid = _grid(b, f, g, model.tables, y - p), _grid(b, f, g, model.tables, p * (1 - p))
        gains.append((_quadrants(*grid)[0], f, g))
    model.pairs = [(f, g) for gain, f, g in sorted(gains, reverse=True)[:most_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[g]))) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for (f, g), table in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-raw))
            gain, step = _quadrants(_grid(b, f, g, model.tables, y - p), _grid(b, f, g, model.tables, p * (1 - p)))
            if gain > 0:
                table += rate * step
                raw += rate * step[b[:, f], b[:, g]]
    return model


def _grid(b, f, g, tables, value) -> np.ndarray:
    shape = len(tables[f]), len(tables[g])
    return np.bincount(b[:, f] * shape[1] + b[:, g], value, shape[0] * shape[1]).reshape(shape)


RIDGE, LEAST = 1.0, 2.0


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leaf values by bin: the best cut, then the best cut on either side."""

    def cut(lo: int, hi: int) -> int | None:
        g, h = np.cumsum(gradient[lo:hi]), np.cumsum(weight[lo:hi])
        left, right = h[:-1], h[-1] - h[:-1]
        gain = g[:-1] ** 2 / (left + RIDGE) + (g[-1] - g[:-1]) ** 2 / (right + RIDGE) - g[-1] ** 2 / (h[-1] + RIDGE)
        gain[(left < LEAST) | (right < LEAST)] = 0
        at = int(gain.argmax()) if len(gain) else 0
        return lo + at + 1 if len(gain) and gain[at] > 1e-9 else None

    n, out = len(gradient), np.zeros(len(gradient))
    ends = [0, n]
    if middle := cut(0, n):
        ends = sorted({0, middle, n, cut(0, middle) or 0, cut(middle, n) or n})
    for lo, hi in zip(ends, ends[1:]):
        out[lo:hi] = gradient[lo:hi].sum() / (weight[lo:hi].sum() + RIDGE)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of both features into four quadrants."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(gradient)

    def four(c):
        a = c[:-1, :-1]
        top, left, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, top - a, left - a, all_ - top - left + a

    gs, hs = four(g), four(h)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + RIDGE)
    gain = np.where(np.minimum.reduce(hs) < LEAST, 0, gain)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(gs, hs)]
    step = np.empty_like(gradient)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), step


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> Model:
    """A model from about ``most_rows`` labelled rows (a documented bound; rows are chosen by doc_id's hash).

    docs: doc_id, text. labels: doc_id, quality (0 or 1; other rows are left
    out). The chosen labels, a bounded table, are sent to the documents; only the
    features of the chosen texts come to the driver.
    """
    small_batches(docs.sparkSession)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    part = min(1.0, most_rows / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part * 1_000_003)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # about most_rows rows of two numbers
    made = rows.select(F.col("quality").cast("double"), _features("text").alias("x"), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    if not len(made):
        return Model([], 0.0, [])
    return fit(np.stack(made.x.to_numpy()).astype(float), made.quality.to_numpy())


def _features(text: str):
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(None if pd.isna(t) else t) for t in texts])

    return run(text)


@passing("doc_id", "text", "held_out")
def scored(docs: DataFrame, model: Model, text: str = "text", good: float = GOOD) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= good, else 0).

    Edge cases: null and empty texts are scored alike, by zero features; very
    long texts are read whole; without labels every score is 0.5; equal texts get
    equal scores; other columns pass through, but the names added here are
    replaced; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(None if pd.isna(t) else t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(shared.value.score(x), dtype=float)

    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", run(text)).withColumn("predicted", (F.col("score") >= good).cast("int"))
