"""Fill-in-the-middle texts: cuts between tokens, taken for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, text_slices

#: Percent of texts that stay plain (from the top of h3), and of the others that are suffix first (from the bottom of h4).
PLAIN_FROM, SPM_BELOW = 90, 20
MARKS = b"<P><S><M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Byte classes: a letter, and the first byte of a code point.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80


def draws(seed: int, doc_id: str = "doc_id") -> Column:
    """Four unsigned numbers: the first 8-digit groups of the hex SHA-256 of ``seed:doc_id`` (a null doc_id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.array(*(F.lit(i) for i in (1, 9, 17, 25))), lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"))


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte position, letter and text of each ``<P>``, ``<S>`` and ``<M>`` that lies within one text."""
    middle = data[1:-1]
    at = np.flatnonzero((data[:-2] == MARKS[0]) & (data[2:] == MARKS[2]) & ((middle == MARKS[1]) | (middle == MARKS[4]) | (middle == MARKS[7])))
    text = np.searchsorted(offsets, at, "right") - 1
    whole = at + 3 <= offsets[text + 1]
    return at[whole], data[at[whole] + 1], text[whole]


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, byte places of both cuts, and code points before the first and between them, of all texts in data at once.

    Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points: a token begins at each
    code point that isn't a letter after a letter of the same text. Their
    running count, less its value where a text begins, numbers the tokens of
    each text; a cut before token k is where the running count reaches k + 1.
    """
    letter = LETTER[data]
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    after[offsets[:-1][offsets[:-1] < len(data)]] = False
    lead = LEAD[data]
    tokens = np.cumsum(lead & ~(letter & after), dtype=np.int32)
    chars = np.cumsum(lead, dtype=np.int32)

    def before(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at > 0, counts[at - 1], 0).astype(np.int64) if len(counts) else np.zeros(len(at), np.int64)

    base = before(tokens, offsets[:-1])
    n = before(tokens, offsets[1:]) - base
    one, two = first % (n + 1), second % (n + 1)
    a = np.searchsorted(tokens, (base + np.minimum(one, two) + 1).astype(np.int32))
    b = np.searchsorted(tokens, (base + np.maximum(one, two) + 1).astype(np.int32))
    a, b = np.minimum(a, offsets[1:]), np.minimum(b, offsets[1:])
    c0, ca, cb = before(chars, offsets[:-1]), before(chars, a), before(chars, b)
    return n, a, b, ca - c0, cb - ca


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of one text per row of starts and ends (byte ranges of data, in their order)."""
    lengths = (ends - starts).ravel()
    to = np.cumsum(lengths)
    total = int(to[-1]) if len(to) else 0
    source = np.repeat(starts.ravel() - (to - lengths), lengths)
    source += np.arange(total)
    offsets = np.zeros(len(starts) + 1, np.int64)
    offsets[1:] = to[starts.shape[1] - 1 :: starts.shape[1]]
    return data[source], offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _arranged(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> pa.StringArray:
    """The texts in their form (0 plain, 1 psm, 2 spm)."""
    pool, at = np.concatenate((data, np.frombuffer(MARKS, np.uint8))), len(data)
    lo, hi = offsets[:-1], offsets[1:]
    p, s, m = (np.full(len(lo), at + k) for k in (0, 3, 6))
    starts = np.stack((np.where(form == 1, p, s), np.where(form == 1, lo, b), np.where(form == 1, s, p), np.where(form == 1, b, lo), m, a), 1)
    ends = np.stack((starts[:, 0] + 3, np.where(form == 1, a, hi), starts[:, 2] + 3, np.where(form == 1, hi, a), m + 3, b), 1)
    plain = form == 0
    starts[plain], ends[plain] = at, at
    starts[plain, 0], ends[plain, 0] = lo[plain], hi[plain]
    return _strings(*_joined(pool, starts, ends))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    A text of n tokens is cut before tokens h1 % (n + 1) and h2 % (n + 1) (see
    ``draws``) into prefix, middle and suffix; psm is ``<P>`` prefix ``<S>`` suffix
    ``<M>`` middle, spm ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. There is no
    shuffle, and the result of a row depends on that row alone. A slice of a
    batch (4 MB, or one longer text) is cut in one go; the arrays take about 25
    bytes for each of its bytes.

    Edge cases: null text counts as empty; empty texts, and texts that hold one
    of the marks, stay plain, with null prefix_chars and middle_chars; a null
    doc_id draws as an empty one; equal rows give equal rows; other columns are
    left out; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), draws(seed).alias("draws"))
    kind = out.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in text_slices(batch, "text"):
                h1, h2, h3, h4 = some["draws"].flatten().to_numpy().reshape(-1, 4).T
                n, a, b, prefix, middle = cuts(data, offsets, h1, h2)
                form = np.where(h4 % 100 < spm_below, 2, 1)
                form[(n == 0) | (h3 % 100 >= plain_from)] = 0
                form[_marks(data, offsets)[2]] = 0
                plain = form == 0
                names = pa.array([PLAIN, PSM, SPM]).take(pa.array(form))
                yield pa.record_batch(
                    [some["doc_id"], pa.array(n), names, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), _arranged(data, offsets, a, b, form)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return out.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """made (columns output and form, others pass through) with the text that each output was made from, read off output and form alone.

    Edge cases: null output or form gives a null text; an output without the
    marks of its form raises ValueError; a column named restored is replaced.
    """
    small_batches(made.sparkSession)
    made = made.drop("restored")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offsets in text_slices(batch, "output"):
                null = some["form"].is_null().to_numpy(False) | some["output"].is_null().to_numpy(False)
                names = some["form"].to_numpy(False)
                form = np.where(names == PSM, 1, np.where(names == SPM, 2, 0))
                form[null] = 0
                at, letter, text = _marks(data, offsets)
                inner = (form[text] > 0) & (at > offsets[text])
                at, letter, text = at[inner], letter[inner], text[inner]
                cut = np.flatnonzero(form)
                if not (np.array_equal(text, np.repeat(cut, 2)) and (letter[1::2] == MARKS[7]).all() and (letter[::2] == np.where(form[cut] == 1, MARKS[4], MARKS[1])).all()):
                    raise ValueError("an output lacks the marks of its form")
                # Parts of an output, after its three marks.
                one, two, end = at[::2], at[1::2], offsets[cut + 1]
                head, tail, middle = (offsets[cut] + 3, one), (one + 3, two), (two + 3, end)
                psm = form[cut] == 1
                starts = np.repeat(offsets[:-1, None], 3, 1)
                ends = starts.copy()
                ends[:, 0] = offsets[1:]
                # Of psm the parts are prefix, suffix, middle; of spm suffix, prefix, middle.
                starts[cut] = np.stack((np.where(psm, head[0], tail[0]), middle[0], np.where(psm, tail[0], head[0])), 1)
                ends[cut] = np.stack((np.where(psm, head[1], tail[1]), middle[1], np.where(psm, tail[1], head[1])), 1)
                texts = _strings(*_joined(data, starts, ends))
                if null.any():
                    texts = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), texts)
                yield pa.record_batch([*some.columns, texts], [*some.schema.names, "restored"])

    return made.mapInArrow(restore, f"{fields}, restored string")
