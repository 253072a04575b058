"""What a reader asks while a book plays: words at times, where a hit is spoken, what is shown and queued."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fnv32_marked
from lectern.operators import intervals
from lectern.operators.ordered import in_pieces, with_summaries

READY, FAILED, PENDING = "ready", "failed", "pending"
IN_FLIGHT = ("synthesizing", "aligning", "encoding")


# -- positions on axes -------------------------------------------------------------------


def flat_words(axis: DataFrame, words: DataFrame) -> DataFrame:
    """words of ready chunks (book, section, chunk, w, s, e from the section's start) on the book's axis."""
    return words.join(axis.select("book", "section", "start_ms"), ["book", "section"]).select(
        "book", "section", "chunk", "w", (F.col("start_ms") + F.col("s")).alias("s"), (F.col("start_ms") + F.col("e")).alias("e"))


def positions(probes: DataFrame, axis: DataFrame) -> DataFrame:
    """probes (book, t, more) with section, start_ms, len_ms, offset and total; a time on a border is in the following section, times outside are clamped."""
    totals = axis.groupBy("book").agg(F.max("end_ms").alias("total"))
    inside = probes.join(totals, "book").withColumn("_t", F.greatest(F.lit(0), F.least("t", "total")))
    found = intervals.as_of(inside, axis, ["book"], "_t", "start_ms", ["section", "start_ms", "len_ms"], "section")
    return found.withColumn("offset", F.greatest(F.lit(0), F.least(F.col("_t") - F.col("start_ms"), F.col("len_ms")))).drop("_t")


def words_at(probes: DataFrame, axis: DataFrame, words: DataFrame) -> DataFrame:
    """probes (book, t, more) with section, chunk and w of the word playing: the last that has begun, else the section's first."""
    where = positions(probes, axis)
    where = where.withColumn("_t", F.greatest("start_ms", F.least("t", F.col("start_ms") + F.col("len_ms"))))
    flat = flat_words(axis, words).withColumn("_n", F.col("chunk") * 100_000 + F.col("w"))
    found = intervals.as_of(where, flat, ["book", "section"], "_t", "s", ["chunk", "w"], "_n", or_first=True)
    return found.select(*probes.columns, "section", "chunk", "w")


def snapshots(probes: DataFrame, axis: DataFrame, chunks: DataFrame, words: DataFrame) -> DataFrame:
    """probes (book, t, more) as progress rows: section, offset, word_idx, percent and the section's start.

    The chunk is the last begun at the offset, else the first; its word the last begun, else 0.
    """
    where = positions(probes, axis).withColumn("percent", F.when(F.col("total") > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("t") / F.col("total") * 100))))
    in_chunk = intervals.as_of(where, chunks, ["book", "section"], "offset", "start_in_section", ["chunk"], "chunk", or_first=True)
    found = intervals.as_of(in_chunk, words, ["book", "section", "chunk"], "offset", "s", ["w"], "w")
    return found.select(*probes.columns, "section", "offset", F.coalesce("w", F.lit(0)).alias("word_idx"), "percent", F.col("start_ms").alias("section_start_ms"))


def to_ready(probes: DataFrame, axis: DataFrame) -> DataFrame:
    """probes (book, t, more) with ready_ms: time on the axis of ready sections; inside a gap the end of the ready section before it."""
    ready = axis.where("ready")
    totals = axis.groupBy("book").agg(F.max("end_ms").alias("_total"))
    inside = probes.join(totals, "book").withColumn("_t", F.greatest(F.lit(0), F.least("t", "_total")))
    found = intervals.as_of(inside, ready, ["book"], "_t", "start_ms", ["ready_start", "start_ms", "len_ms"], "section")
    at = F.col("ready_start") + F.least(F.col("_t") - F.col("start_ms"), F.col("len_ms"))
    return found.select(*probes.columns, F.coalesce(at, F.lit(0)).alias("ready_ms"))


def timed_tokens(tokens: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """tokens with the times of the words at the same place of their paragraph; those beyond the last word have none.

    tokens: by, ti. words: by, chunk, w, s, e. Places are running numbers on both sides.
    """
    place = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return tokens.withColumn("_k", place("ti")).join(words.withColumn("_k", place("chunk", "w")).drop("w", "chunk"), [*by, "_k"], "left").drop("_k")


def timed_in_place(tokens: Column, words: Column) -> Column:
    """timed_tokens where a row holds its paragraph's tokens and words (word, s) as arrays in their order: an array of (token, word, s), without a shuffle."""
    return F.transform(tokens, lambda token, i: F.struct(token.alias("token"), F.get(words, i)["word"].alias("word"), F.get(words, i)["s"].alias("s")))


def section_of_page(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """pages (book, page) with the section that owns them: the last that starts on the page or before, else the first."""
    return intervals.as_of(pages, bounds, ["book"], "page", "first_page", ["section"], "section", or_first=True)


def monotone(words: DataFrame, by: list[str]) -> DataFrame:
    """words (by, w, s, e, duration_ms) with s and e clamped: never descending, within the duration, the last e equal to it."""
    order = Window.partitionBy(*by).orderBy("w")
    s = F.max(F.least("s", "duration_ms")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    made = words.withColumn("_last", F.lead("w").over(order).isNull()).withColumn("s", F.greatest(F.lit(0), s))
    return made.withColumn("e", F.when(F.col("_last"), F.col("duration_ms")).otherwise(F.greatest("s", F.least("e", "duration_ms")))).drop("_last")


def aligned_words(rows: DataFrame, by: list[str]) -> DataFrame:
    """An aligner's rows (by, at, word, s, e, n_words, duration_ms) as words: empty ones go, the first n_words stay, times are clamped."""
    order = Window.partitionBy(*by).orderBy("at")
    kept = rows.where("word <> ''").withColumn("w", F.row_number().over(order) - 1).where("w < n_words")
    return monotone(kept.select(*by, "w", "s", "e", "duration_ms"), by)


# -- search ------------------------------------------------------------------------------


def search(items: DataFrame, needle: str, cap: int = 30) -> DataFrame:
    """(book, sec, para, sent, at, rank): hits in titles and sentences in the order of the book, the first ``cap`` of each book.

    items: book, sec, para, sent, title, text. A section's title is a hit once,
    before its first sentence, with sent -1. The cap is the search box's own. A needle below two characters finds nothing.
    """
    needle = needle.strip().lower()
    if len(needle) < 2:
        return items.limit(0).select("book", "sec", "para", "sent", F.lit(0).alias("at"), F.lit(0).alias("rank"))
    hit = lambda c: F.instr(F.lower(c), needle) - 1
    looked = items.select("book", "sec", "para", "sent", hit(F.col("title")).alias("_title"), hit(F.col("text")).alias("_text")).where("_title >= 0 OR _text >= 0")
    # Each row is a hit of its sentence, and may be its section's first row, which stands for the title.
    kinds = F.array(F.struct(F.lit(0).alias("_kind"), F.lit(-1).alias("_sent"), F.col("_title").alias("at")), F.struct(F.lit(1).alias("_kind"), F.col("sent").alias("_sent"), F.col("_text").alias("at")))
    found = looked.select("book", "sec", "para", "sent", F.inline(kinds)).where("at >= 0")
    nth = F.row_number().over(Window.partitionBy("book", "sec", "_kind").orderBy("para", "sent"))
    once = found.withColumn("_nth", nth).where("_kind = 1 OR _nth = 1").select("book", "sec", "para", F.col("_sent").alias("sent"), "at")
    rank = F.row_number().over(Window.partitionBy("book").orderBy("sec", F.col("sent") >= 0, "para", "sent"))
    return once.withColumn("rank", rank).where(F.col("rank") <= cap)


def spoken_at(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (sec, para, sent, more) with the first chunk (sec, para, n, s0, s1) that covers their sentence; null where none does.

    Chunks of a paragraph are ranges without overlap but for pieces of one unit, so the join by paragraph makes few rows a hit.
    """
    c = chunks.select("sec", "para", "n", "s0", "s1")
    within = hits.join(c, ["sec", "para"], "left").where("s0 IS NULL OR (sent >= s0 AND sent <= s1)")
    first = within.groupBy(*hits.columns).agg(F.min("n").alias("n"))
    return hits.join(first.select("sec", "para", "sent", "n"), ["sec", "para", "sent"], "left")


# -- status, queue and library ---------------------------------------------------------------


def overlaid(sections: DataFrame, live: DataFrame) -> DataFrame:
    """sections with shown: a pending section that is being worked on (in live) shows as such."""
    marked = sections.join(live.select("book", "section", F.lit(True).alias("_live")), ["book", "section"], "left")
    return marked.withColumn("shown", F.when(F.col("_live") & (F.col("status") == PENDING), "synthesizing").otherwise(F.col("status"))).drop("_live")


def needed(sections: DataFrame, live: DataFrame) -> DataFrame:
    """sections (book, section, status, forced) with needs: whether they are to be narrated.

    A finished one isn't, nor a failed one unless forced; one in flight is only where nobody works on it.
    """
    marked = sections.join(live.select("book", "section", F.lit(True).alias("_live")), ["book", "section"], "left")
    status = F.coalesce("status", F.lit(PENDING))
    rule = F.when(F.col("forced") & (status == FAILED), True).when(status.isin(READY, FAILED), False).when(status.isin(*IN_FLIGHT), F.col("_live").isNull()).otherwise(True)
    return marked.withColumn("needs", rule).drop("_live")


def targets(sections: DataFrame, boosts: DataFrame, budget: int) -> DataFrame:
    """(book, section, lane): lane 1 holds each boosted section and its successor, lane 2 what follows until its chunks fill the budget.

    sections: book, section, status, n_chunks. boosts: book, section. A failed
    section is taken up again only where it is boosted itself. The section that
    passes the budget is still in; lane 2 begins behind the last boost.
    """
    wanted = boosts.select("book", F.explode(F.array(F.struct("section", F.lit(True).alias("own")), F.struct((F.col("section") + 1).alias("section"), F.lit(False).alias("own")))).alias("b"))
    wanted = wanted.groupBy("book", F.col("b.section").alias("section")).agg(F.bool_or("b.own").alias("_own"))
    open_ = F.col("status") == PENDING
    marked = sections.join(wanted, ["book", "section"], "left").join(boosts.groupBy("book").agg(F.max("section").alias("_cursor")), "book", "left")
    one = F.coalesce(F.col("_own").isNotNull() & (open_ | (F.col("_own") & (F.col("status") == FAILED))), F.lit(False))
    marked = marked.withColumn("lane", F.when(one, 1).when(open_ & (F.col("section") > F.coalesce("_cursor", F.lit(-1))), 2)).where("lane IS NOT NULL")
    w = Window.partitionBy("book", "lane").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("n_chunks").over(w), F.lit(0))
    return marked.withColumn("_spent", spent).where((F.col("lane") == 1) | (F.col("_spent") < budget)).select("book", "section", "lane")


def demoted(queue: DataFrame, target: DataFrame, live: DataFrame) -> DataFrame:
    """queue (book, section, pri) with the tier after the window has moved: cold (2) outside it, unless worked on; cold ones inside it become 1."""
    marked = queue.join(target.select("book", "section").distinct().withColumn("_in", F.lit(True)), ["book", "section"], "left")
    marked = marked.join(live.select("book", "section", F.lit(True).alias("_live")), ["book", "section"], "left")
    return marked.withColumn("tier", F.when(F.col("_in") & (F.col("pri") == 2), 1).when(F.col("_in") | F.col("_live"), F.col("pri")).otherwise(2)).drop("_in", "_live")


def boost(sections: DataFrame, current: DataFrame, most: int = 400) -> DataFrame:
    """(book, section) to begin with where nothing is ready or in flight: the current one if it is pending and not too long, else the shortest pending one."""
    idle = sections.groupBy("book").agg(F.bool_or(F.col("status").isin(READY, *IN_FLIGHT)).alias("busy"), F.min(F.when(F.col("status") == PENDING, F.struct("n_chunks", "section"))).alias("least")).where("NOT busy AND least IS NOT NULL")
    now = current.join(sections, ["book", "section"]).select("book", F.when((F.col("status") == PENDING) & (F.col("n_chunks") <= most), F.col("section")).alias("_now"))
    return idle.join(now, "book", "left").select("book", F.coalesce("_now", "least.section").alias("section"))


def generation(sections: DataFrame) -> DataFrame:
    """(book, total, ready, failed, active) of each book's sections."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return sections.groupBy("book").agg(F.count(F.lit(1)).alias("total"), count(READY).alias("ready"), count(FAILED).alias("failed"), count(*IN_FLIGHT).alias("active"))


def merged_timings(slim: DataFrame, fetched: DataFrame) -> DataFrame:
    """slim sections (book, section, status, words) with words fetched for those that are ready and have none."""
    f = fetched.select("book", "section", F.col("words").alias("_words"))
    lacks = (F.col("status") == READY) & F.col("words").isNull()
    return slim.join(f, ["book", "section"], "left").withColumn("words", F.when(lacks, F.col("_words")).otherwise(F.col("words"))).drop("_words")


def engine_stamp(remote: Column, local: Column, model: str = "remote", engine: str = "local") -> Column:
    """Which engine made a section: by numbers of chunks made away and here."""
    return F.when((remote > 0) & (local > 0), f"{model}+{engine}").when(remote > 0, model).otherwise(engine)


# -- shelves --------------------------------------------------------------------------------

# fixed values that results depend on
CLOTHS, TILTS = 10, 4
WIDTHS = (30, 33, 36, 40, 40, 44, 44, 48, 54)


def moved_table(values: tuple, behind: int) -> np.ndarray:
    """For each index, seed and looks of the ``behind`` neighbours before (None is the last): the index shown.

    It is the index itself if its value is no neighbour's, else the first such
    of the others, tried from the seed around the circle.
    """
    n = len(values)
    known = [*values, None]
    out = np.empty((n, n - 1, *(n + 1,) * behind), np.int64)
    for base, seed, *near in np.ndindex(*out.shape):
        taken = {known[i] for i in near}
        tried = [base, *((base + (seed + k) % (n - 1) + 1) % n for k in range(n - 1))]
        out[base, seed, *near] = next(i for i in tried if values[i] not in taken)
    return out


class _Looks:
    """The three looks of a shelf as machines of few states: cloths of the two books before, width and tilt of the one before."""

    def __init__(self):
        n = CLOTHS + 1
        cloth = moved_table(tuple(range(CLOTHS)), 2)
        # States are numbers: older * n + newer; a step forgets the older one.
        older, newer = np.divmod(np.arange(n * n), n)
        self.cloth = newer * n + cloth[:, :, newer, older]
        self.width = moved_table(WIDTHS, 1)
        self.tilt = moved_table(tuple(range(TILTS)), 1)
        self.sizes = (n * n, len(WIDTHS) + 1, TILTS + 1)
        self.start = [size - 1 for size in self.sizes]

    def tables(self, rows: np.ndarray):
        """The three steps of each book of rows (c, cs, w, ws, t, ts)."""
        return self.cloth[rows[:, 0], rows[:, 1]], self.width[rows[:, 2], rows[:, 3]], self.tilt[rows[:, 4], rows[:, 5]]


HASHES = ["c", "cs", "w", "ws", "t", "ts"]
#: What stands before a title where it is hashed; for each of HASHES, the scale and the delay, the mark's number and the values it is brought to.
MARKS = ("", "#", "|", "w#", "=", "t#", "~")
HASHED = ((0, CLOTHS), (1, CLOTHS - 1), (2, len(WIDTHS)), (3, len(WIDTHS) - 1), (4, TILTS), (5, TILTS - 1), (6, 11), (0, 40))


def spines(books: DataFrame, pieces: int | None = None) -> DataFrame:
    """(shelf, id, cloth, width, tilt, scale, delay): looks by the hash of a title, moved where they would repeat a neighbour's.

    books: shelf, at (place on it), id, title. A cloth differs from the two
    before it, width and tilt from the one before. What a book shows depends on
    the two before it only, so a run of books is a map from few states to few
    states: a shelf lies in as many pieces as it needs, the maps of its pieces are composed
    into the state that each one begins with, and then all pieces are folded.
    No row or task holds a whole shelf.

    Edge cases: a null shelf is a shelf, a null title hashes as an empty one; of one place the least id comes first.
    """
    kind = {f.name: f.dataType.simpleString() for f in books.schema.fields}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c", "cs", "w", "ws", "t", "ts", "scale", "delay"]
        for batch in batches:
            h = fnv32_marked(batch["title"].to_pylist(), MARKS)
            columns = [pa.array((h[i] % n).astype(np.int32)) for i, n in HASHED]
            yield pa.record_batch([batch["shelf"], batch["at"], batch["id"], *columns], ["shelf", "at", "id", *names])

    rows = books.select("shelf", "at", "id", F.coalesce("title", F.lit("")).alias("title")).mapInArrow(hashed, f"shelf {kind['shelf']}, at {kind['at']}, id {kind['id']}, c int, cs int, w int, ws int, t int, ts int, scale int, delay int")
    order = ["at", "id", *HASHES]
    cut = in_pieces(rows, ["shelf"], order, pieces)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    # Shelves of several pieces: of each piece the map from the state before it to the one behind it.
    parts = cut.select("shelf", "piece").distinct().withColumn("next", F.lead("piece").over(Window.partitionBy("shelf").orderBy("piece"))).where("next IS NOT NULL")
    going_on = with_summaries(cut, parts, ["shelf"], ["next"]).where("next IS NOT NULL")
    inside = F.row_number().over(Window.partitionBy("piece", "shelf").orderBy(*order))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks, held, maps = _Looks(), None, None
        for batch in batches:
            steps = looks.tables(_hashes(batch))
            starts = np.flatnonzero(batch["nth"].to_numpy() == 1).tolist()
            runs = sorted({0, *starts, batch.num_rows})
            for lo, hi in zip(runs[:-1], runs[1:]):
                run = [_composed(table[lo:hi]) for table in steps]
                if lo in starts:
                    if held is not None:
                        yield _with_column(held, "map", maps)
                    maps = run
                else:
                    maps = [after[m] for after, m in zip(run, maps)]
                held = batch.slice(lo, 1).select(["shelf", "next"])
        if held is not None:
            yield _with_column(held, "map", maps)

    composed = going_on.withColumn("nth", inside).mapInArrow(compose, f"shelf {kinds['shelf']}, next int, map array<int>")

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame, looks, out = frame.sort_values("next"), _Looks(), []
        cuts = np.cumsum(looks.sizes)[:-1]
        state = looks.start
        for m in frame["map"]:
            state = [int(part[x]) for part, x in zip(np.split(np.asarray(m), cuts), state)]
            out.append(state)
        return pd.DataFrame({"shelf": frame["shelf"], "piece": frame["next"], "state": out})

    # At most a row for each piece of the table; a map is 136 numbers.
    states = composed.groupBy("shelf").applyInPandas(begin, f"shelf {kinds['shelf']}, piece int, state array<int>")
    numbered = with_summaries(cut, states, ["shelf"], ["state"]).withColumn("nth", inside)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks, state = _Looks(), None
        cloth, width, tilt = looks.cloth.tolist(), looks.width.tolist(), looks.tilt.tolist()
        for batch in batches:
            firsts = np.flatnonzero(batch["nth"].to_numpy() == 1)
            starts = dict(zip(firsts.tolist(), batch["state"].take(pa.array(firsts)).to_pylist()))
            shown = []
            for i, (c, cs, w, ws, t, ts) in enumerate(_hashes(batch).tolist()):
                if i in starts:
                    state = starts[i] or looks.start
                state = (cloth[c][cs][state[0]], width[w][ws][state[1]], tilt[t][ts][state[2]])
                shown.append(state)
            shown = np.array(shown, np.int32).reshape(-1, 3)
            shown[:, 0] %= CLOTHS + 1
            looked = [pa.array(shown[:, k]) for k in range(3)]
            yield pa.record_batch([batch["shelf"], batch["id"], *looked, batch["scale"], batch["delay"]], ["shelf", "id", "cloth", "w", "tilt", "scale", "delay"])

    made = numbered.mapInArrow(fold, f"shelf {kinds['shelf']}, id {kinds['id']}, cloth int, w int, tilt int, scale int, delay int")
    width = F.get(F.array(*map(F.lit, WIDTHS)), F.col("w")).alias("width")
    return made.select("shelf", "id", "cloth", width, (F.col("tilt") + 82).alias("tilt"), (F.lit(0.9) + F.col("scale") / 100).alias("scale"), (F.col("delay") / 10).alias("delay"))


def _composed(maps: np.ndarray) -> np.ndarray:
    """The map of a run of rows, each of which is a map of states: neighbours are composed until one is left."""
    while len(maps) > 1:
        pairs = len(maps) // 2
        joined = np.take_along_axis(maps[1 : 2 * pairs : 2], maps[: 2 * pairs : 2], 1)
        maps = np.concatenate((joined, maps[2 * pairs :]))
    return maps[0]


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[c].to_numpy() for c in HASHES], 1)


def _with_column(row: pa.RecordBatch, name: str, maps: list[np.ndarray]) -> pa.RecordBatch:
    value = pa.array([np.concatenate(maps).astype(np.int32)], pa.list_(pa.int32()))
    return pa.record_batch([*row.columns, value], [*row.schema.names, name])


# -- small rules ---------------------------------------------------------------------------


def duration_text(ms: Column) -> Column:
    """``47m``, ``1h 05m``: minutes to the nearest, halves up."""
    minutes = F.floor(ms / 60_000 + 0.5)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(hours == 0, F.concat(rest.cast("string"), F.lit("m"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), F.lpad(rest.cast("string"), 2, "0"), F.lit("m")))


def clock(ms: Column) -> Column:
    """``m:ss``, to the nearest second, halves up, 0 at least."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness in [0, 1] of a colour of 0 to 255."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, d = (high + low) / 2, high - low
    s = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - high - low)).otherwise(d / (high + low))
    turn = F.when(high == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, 0.0).otherwise(turn * 60), s, light


def page_at(x: Column, step: Column) -> Column:
    """Page of a place along the strip, to the nearest, halves up; 0 without a step."""
    return F.when(step <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor(F.try_divide(x, step) + 0.5))).cast("int")


def page_count(strip: Column, step: Column) -> Column:
    """Pages of a strip; one at least."""
    return F.when((step <= 0) | (strip <= 0), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.try_divide(strip, step)))).cast("int")


def alignment_mode(setting: Column, available: bool) -> Column:
    """The mode that a setting stands for: interpolation if asked for or if no aligner is there."""
    best = F.lit("whisperx" if available else "interp")
    return F.when(F.lower(F.coalesce(F.nullif(setting, F.lit("")), F.lit("auto"))) == "interp", "interp").otherwise(best)


def time_left(end: Column, at: Column, rate: Column) -> Column:
    """Wall-clock time until a position plays at a rate of one half at least."""
    return F.greatest(F.lit(0.0), (end - at) / F.greatest(F.lit(0.5), rate))


def audio_ms(frames: Column, rate: Column) -> Column:
    return F.bround(frames / rate * 1000).cast("long")


def is_audio_name(name: Column) -> Column:
    """Final audio or a playable beginning; no other files are served."""
    return name.rlike(r"^(section|partial)-.*\.mp3$")


def with_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns that it lacks, at their defaults: a migration that can run again."""
    return df.withColumns({name: value for name, value in columns.items() if name not in df.columns})
