"""Text rules as Column expressions: normalising, words, sentences, units, chunks.

Everything here works on one row at a time, on arrays inside it, so no rule
costs a shuffle. Only composing characters (NFC) needs Python, and only rows
with code points from U+0300 on are sent there.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- fixed values that results depend on ---------------------------------------------
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st",
    "\u0132": "IJ", "\u00c6": "AE", "\u00e6": "ae", "\u0153": "oe", "\u0152": "OE", "\u00de": "TH", "\u00fe": "th",
}
#: Ranges of code points that stay.
KEPT = ((0x0A, 0x0A), (0x20, 0x7E), (0xA2, 0xFF), (0x2010, 0x2027), (0x2030, 0x205F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF), (0x2500, 0x259F))
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st sen gen col capt lieut maj sgt adj adm rev hon fr inq vs etc eg ie vol nos fig cf inc ltd dept "
    "est approx pref ed eds trans ch pp sec para jan feb mar apr jun jul aug sep oct nov dec "
    "govt eng phil technol comput univ inst math"
).split()
NEVER_FINAL = (".", "-", "--", "\u2013", "\u00b7", "\u2022", "\u00b0")
MATH = "\u2282\u2283\u2208\u2209\u222b\u2192\u2190\u2193\u2191\u2264\u2265\u2211\u220f\u221a\u221e\u221d\u2200\u2203\u2204\u2227\u2228\u2261\u2248\u2245\u2260\u2286\u2287\u2288\u228a\u228b\u22c0\u22c1\u22c2\u22c3\u21d2\u21d4\u2234\u2235\u2236\u2207\u2202\u00d7\u00f7\u00b1\u2212"
TERMINAL = "[,.!?\u2014:;]"
CLOSERS = "\"\u201d\u2019')]"
BLANK = " \\t\u00a0\u2000-\u200b"
#: Runs of blanks that aren't one space already.
BLANKS = f"[{BLANK[1:]}][{BLANK}]*| [{BLANK}]+"
MOST_CHUNK, MOST_SENTENCE, LEAST_CHUNK = 300, 500, 40
BREAK = "\u0001"


@F.pandas_udf(StringType())  # a type, not DDL: no session exists yet when this is imported
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC. All code points below U+0300 are composed already."""
    needs = text.rlike("[^\\x{0}-\\x{2ff}]")
    return F.when(needs, _compose(F.when(needs, text))).otherwise(text)


def kept_class() -> str:
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in KEPT)


def _rare(members: str) -> str:
    """A class of code points outside printable ASCII: one comparison settles most characters, where Java tests a class of many ranges one by one."""
    return f"[[^\\x20-\\x7e]&&[{members}]]"


def normalized(text: Column) -> Column:
    """Composed, ligatures written out, odd breaks and blanks made plain, all but the kept code points dropped."""
    return reduced(composed(F.coalesce(text, F.lit(""))))


def reduced(whole: Column) -> Column:
    """normalized of a text that is composed and not null."""
    usual = ~whole.rlike(r"[^\x20-\x7e]")
    out = whole
    for odd, plain in LIGATURES.items():
        out = F.replace(out, F.lit(odd), F.lit(plain))
    out = F.when(whole.rlike(_rare("".join(LIGATURES))), out).otherwise(whole)  # few texts hold any
    out = F.translate(out, "\u2028\u2029\x0b\t\u00a0\u00ad\r", "\n\n\n  ")
    return F.when(usual, whole).otherwise(F.regexp_replace(out, _rare(f"^{kept_class()}"), ""))


def cleaned(text: Column) -> Column:
    """Runs of blanks (not newlines) made one space, both ends stripped."""
    return F.regexp_replace(F.regexp_replace(text, BLANKS, " "), r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between single spaces; an empty text has one empty word."""
    return F.split(cleaned(text), " ")


def tokens(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def ends_terminal(text: Column) -> Column:
    """Whether a text ends in a pause mark, behind which quotes, brackets and blanks may stand."""
    return text.rlike(f"{TERMINAL}[\\s\"\u201d\u2019')\\]]*$")


def is_abbreviation(word: Column) -> Column:
    core = F.rtrim(word, F.lit(".\"'\u2019\u201d)]"))
    low = F.btrim(F.lower(core), F.lit("."))
    return core.isin(*NEVER_FINAL) | low.isin(*ABBREVIATIONS) | word.rlike(r"^([A-Za-z]\.)+$") | core.rlike(r"^\p{Lu}$")


def ends_sentence(word: Column) -> Column:
    body = F.rtrim(word, F.lit("\"'\u201d\u2019)]"))
    return body.rlike(r"[.!?]$") & body.rlike(r"[\p{L}\p{N}]") & ~is_abbreviation(word)


def starts_sentence(word: Column) -> Column:
    return word.rlike("^[\u201c\u2018'\"(\\[\\-\\p{Lu}]")


def sentences(text: Column) -> Column:
    """Sentences of a cleaned paragraph; an empty one has none. A break depends on two neighbouring words only.

    One pass marks the gaps between a word that ends in a full stop, question or
    exclamation mark (closing marks behind it aside) and one that can begin a
    sentence; only words before such gaps are looked at more closely.
    """
    marked = F.regexp_replace(text, "([.!?][\"'\u201d\u2019)\\]]*) (?=[\u201c\u2018'\"(\\[\\-\\p{Lu}])", f"$1{BREAK}")

    def of(parts: Column) -> Column:
        last = F.size(parts) - 1

        def closed(part: Column, i: Column) -> Column:
            ends = (i < last) & ends_sentence(F.substring_index(part, " ", -1))
            return F.concat(part, F.when(ends, F.lit(BREAK)).otherwise(F.lit(" ")))

        return F.transform(F.split(F.array_join(F.transform(parts, closed), ""), BREAK), lambda s: F.trim(s))

    found = F.transform(F.array(F.split(marked, BREAK)), of)[0]
    return F.when(text == "", F.array().cast("array<string>")).when(~marked.contains(BREAK), F.array(F.trim(text))).otherwise(F.filter(found, lambda s: s != ""))


def each(df: DataFrame, *keep: str, value: Column, names: tuple[str, str]) -> DataFrame:
    """A row for each element of an array, with its place and itself under ``names``.

    From a plain posexplode Catalyst infers that the array isn't empty and computes
    it a second time to filter for that, through all projections below; the outer
    one leaves it alone, and rows of empty arrays go by their missing place.
    """
    return df.select(*keep, F.posexplode_outer(value).alias(*names)).where(F.col(names[0]).isNotNull())


def settled(df: DataFrame, *keep: str, value: Column, name: str) -> DataFrame:
    """keep and value under ``name``, computed once a row.

    Through a projection Catalyst pushes every later filter on the column, so
    that it is computed for the filter and again for the rows that stay; what a generator gives stays whole.
    """
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def units(sents: Column) -> Column:
    """array<struct<s0,s1,text>>: sentences joined until one ends in a pause mark; what is left over is a unit too."""

    def of(flagged: Column) -> Column:
        marked = F.transform(flagged, lambda s: F.concat(s["s"], F.when(s["e"], F.lit(BREAK)).otherwise(F.lit(" "))))
        texts = F.filter(F.transform(F.split(F.array_join(marked, ""), BREAK), lambda u: F.trim(u)), lambda u: u != "")
        ends = F.filter(F.transform(flagged, lambda s, i: F.when(s["e"] | (i == F.size(flagged) - 1), i)), lambda i: i.isNotNull())

        def join(e: Column) -> Column:
            return F.zip_with(
                F.transform(e, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(e, i - 1) + 1).alias("s0"), x.alias("s1"))), texts,
                lambda r, t: F.struct(r["s0"].alias("s0"), r["s1"].alias("s1"), t.alias("text")),
            )

        return _let(ends, join)

    return _let(F.transform(sents, lambda s: F.struct(s.alias("s"), ends_terminal(s).alias("e"))), of)


def _word_bounded(text: Column) -> Column:
    """Pieces that end with the first word at which they reach MOST_CHUNK characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        now = F.when(acc["now"].isNull(), w).otherwise(F.concat_ws(" ", acc["now"], w))
        full = F.length(now) >= MOST_CHUNK
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(~full, now).alias("now"))

    return F.aggregate(F.split(text, " "), empty, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def long_pieces(text: Column) -> Column:
    """Pieces of a unit above MOST_SENTENCE characters, cut behind clause marks, else at words; a shorter one is itself."""
    cut = F.filter(F.transform(F.split(text, "(?<=[,;:\u2014\u2013])\\s+"), lambda p: F.trim(p)), lambda p: p != "")
    # A piece that doesn't end in a pause mark goes on with the next one.
    marked = F.transform(cut, lambda p: F.concat(p, F.when(ends_terminal(p), F.lit(BREAK)).otherwise(F.lit(" "))))
    joined = F.filter(F.transform(F.split(F.array_join(marked, ""), BREAK), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.length(text) <= MOST_SENTENCE, F.array(text)).when(F.size(cut) < 2, _word_bounded(text)).otherwise(joined)


def chunks(unit_list: Column) -> Column:
    """array<struct<s0,s1,text>>: units packed up to MOST_CHUNK characters; each piece of an oversized unit is a chunk of its own.

    The fold looks at lengths and leaves a mark for each unit (1: a chunk begins,
    0: it goes on, 2: cut into pieces); texts are joined once, by those marks.
    """

    def of(us: Column) -> Column:
        def step(acc: Column, u: Column) -> Column:
            several, n = F.size(u["pieces"]) > 1, F.length(u["text"])
            fits = (acc["n"] >= 0) & (acc["n"] + 1 + n <= MOST_CHUNK)
            mark = F.when(several, "2").when(fits, "0").otherwise("1")
            return F.struct(F.concat(acc["marks"], mark).alias("marks"), F.when(several, -1).when(fits, acc["n"] + 1 + n).otherwise(n).alias("n"))

        def cut(marks: Column) -> Column:
            starts = F.filter(F.transform(us, lambda u, i: F.when(F.substring(marks, i + 1, F.lit(1)) != "0", i)), lambda i: i.isNotNull())

            def chunk(ss: Column) -> Column:
                def one(i: Column, k: Column) -> Column:
                    u, end = F.get(us, i), F.coalesce(F.get(ss, k + 1), F.size(us)) - 1
                    part = lambda s1, t: F.struct(u["s0"].alias("s0"), s1.alias("s1"), t.alias("text"))
                    whole = F.array(part(F.get(us, end)["s1"], F.array_join(F.transform(F.slice(us, i + 1, end - i + 1), lambda x: x["text"]), " ")))
                    return F.when(F.size(u["pieces"]) > 1, F.transform(u["pieces"], lambda p: part(u["s1"], p))).otherwise(whole)

                return F.flatten(F.transform(ss, one))

            return _let(starts, chunk)

        start = F.struct(F.lit("").alias("marks"), F.lit(-1).alias("n"))
        return _let(F.aggregate(us, start, step, lambda a: a["marks"]), cut)

    return _let(F.transform(unit_list, lambda u: F.struct(u["s0"].alias("s0"), u["s1"].alias("s1"), u["text"].alias("text"), long_pieces(u["text"]).alias("pieces"))), of)


def symbol_density(text: Column) -> Column:
    """Share of mathematical symbols among the characters that aren't white space; 0 for a blank text."""
    symbol = _rare(MATH)
    found = F.regexp_count(text, F.lit(symbol)) / (F.length(text) - F.regexp_count(text, F.lit(r"\s")))
    return F.when(~text.rlike(symbol), F.lit(0.0)).otherwise(found)  # few texts hold any


def looks_like_code(text: Column) -> Column:
    # The look ahead settles most characters by one table of bits.
    return F.regexp_count(text, F.lit(r"(?=[{};\-=:&])(?:\{|\}|;|->|=>|::|&&)")) >= 2


def fnv32(text: Column) -> Column:
    """FNV-1a, 32 bits, over the text's UTF-16 units."""
    def step(h: Column, c: Column) -> Column:
        return F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32))

    def units(c: Column) -> Column:
        beyond = c - 0x10000
        return F.when(c >= 0x10000, F.array(F.shiftright(beyond, 10) + 0xD800, beyond % 0x400 + 0xDC00)).otherwise(F.array(c))

    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(F.flatten(F.transform(points, units)), F.lit(2166136261), step)


def fnv32_marked(texts: list[str], marks: tuple[str, ...]) -> np.ndarray:
    """fnv32 of many texts at once, with each of ``marks`` before them: a row for each mark."""
    lengths, data = np.empty(len(texts), np.int64), []
    for i, t in enumerate(texts):
        data.append(t.encode("utf-16-le", "surrogatepass"))
        lengths[i] = len(data[-1]) // 2
    units, starts = np.frombuffer(b"".join(data), np.uint16).astype(np.uint64), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, left = starts[order], np.sort(lengths)
    h = np.empty((len(marks), len(texts)), np.uint64)
    prime, low = np.uint64(16777619), np.uint64(0xFFFFFFFF)
    for k, mark in enumerate(marks):
        first = 2166136261
        for c in np.frombuffer(mark.encode("utf-16-le"), np.uint16).tolist():
            first = (first ^ c) * 16777619 % (1 << 32)
        h[k] = first
    # Longest first: the texts that have a unit at a place are the first ones.
    for at in range(int(left[-1]) if len(left) else 0):
        n = len(left) - int(np.searchsorted(left, at, "right"))
        h[:, :n] = (h[:, :n] ^ units[starts[:n] + at]) * prime & low
    out = np.empty_like(h)
    out[:, order] = h
    return out
