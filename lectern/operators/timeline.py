"""Sections and chunks on time axes, word timings, and what to narrate next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import running_sums


def timeline(sections: DataFrame) -> DataFrame:
    """sections (book, section, status, duration_ms, partial_ms) with start and end on the global and the ready axis.

    A section that isn't ready but has a playable beginning counts as ready with that length.
    A book of any number of sections is summed in pieces.
    """
    partial = (F.col("status") != "ready") & (F.coalesce("partial_ms", F.lit(0)) > 0)
    d = F.greatest(F.lit(0), F.when(partial, F.col("partial_ms")).otherwise(F.coalesce("duration_ms", F.lit(0))))
    made = sections.withColumn("len_ms", d).withColumn("ready", (F.col("status") == "ready") | partial)
    ready_len = F.when(F.col("ready"), F.col("len_ms")).otherwise(0)
    summed = running_sums(made.select("book", "section", "status", "len_ms", "ready"), ["book"], ["section"], {"end_ms": F.col("len_ms"), "_ready_end": ready_len})
    return summed.select(
        "book", "section", "status", "len_ms", "ready",
        (F.col("end_ms") - F.col("len_ms")).alias("start_ms"), "end_ms", (F.col("_ready_end") - ready_len).alias("ready_start"),
    )


def playable_prefix(chunks: DataFrame) -> DataFrame:
    """(book, section, playable, playable_ms): finished chunks before the first unfinished one."""
    w = Window.partitionBy("book", "section").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    open_ = chunks.withColumn("_ok", F.min(F.col("done").cast("int")).over(w) == 1)
    return open_.groupBy("book", "section").agg(F.count_if("_ok").alias("playable"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("duration_ms"))), F.lit(0)).alias("playable_ms"))


def pause_ms(word) -> F.Column:
    """Pause behind a word by its last character before closing marks."""
    last = F.right(F.rtrim(word, F.lit("\"'”’»)]}")), F.lit(1))
    return F.when(last.isin(".", "!", "?"), 200).when(last.isin(",", "—", ":"), 100).otherwise(0)


def word_timings(texts: DataFrame) -> DataFrame:
    """texts (key columns, text, duration_ms) with w, s and e of each word.

    Pauses come off the duration (halved against it where they exceed it), the
    rest is shared by len + 2. Times are one division of running integer sums,
    so no error adds up; e never exceeds the duration and the last e equals it.
    One row's words stay in one row until the end: no shuffle.
    """
    keys = [c for c in texts.columns if c not in ("text", "duration_ms")]
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1))
    made = texts.withColumn("_w", words).where((F.size("_w") > 0) & (F.col("duration_ms") > 0))
    n = F.size("_w")
    made = made.withColumn("_p", F.transform("_w", lambda x, i: F.when(i < n - 1, pause_ms(x)).otherwise(0)))
    made = made.withColumn("_total", F.aggregate("_p", F.lit(0), lambda a, x: a + x)).withColumn("_weight", F.aggregate("_w", F.lit(0), lambda a, x: a + F.length(x) + 2))
    half = F.col("duration_ms") * 0.5
    made = made.withColumn("_scale", F.when(F.col("_total") >= F.col("duration_ms"), half / F.col("_total")).otherwise(1.0))
    made = made.withColumn("_speech", F.col("duration_ms") - F.col("_total") * F.col("_scale"))
    start = F.struct(F.lit(0).alias("cw"), F.lit(0).alias("cp"), F.array().cast("array<struct<cw:int,cp:int,w:int,p:int>>").alias("out"))

    def step(acc, i):
        w, p = F.length(F.get("_w", i)) + 2, F.get("_p", i)
        row = F.struct(acc["cw"].alias("cw"), acc["cp"].alias("cp"), w.alias("w"), p.alias("p"))
        return F.struct((acc["cw"] + w).alias("cw"), (acc["cp"] + p).alias("cp"), F.array_append(acc["out"], row).alias("out"))

    made = made.withColumn("_sums", F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda a: a["out"]))
    flat = made.select(*keys, "duration_ms", "_speech", "_weight", "_scale", n.alias("_n"), F.posexplode_outer("_sums").alias("w", "_x"))  # outer: no filter on the sums is inferred and pushed below
    paused = F.col("_x.cp") * F.col("_scale")
    s = F.bround(F.col("_speech") * F.col("_x.cw") / F.col("_weight") + paused)
    e = F.bround(F.least(F.col("duration_ms"), F.col("_speech") * (F.col("_x.cw") + F.col("_x.w")) / F.col("_weight") + paused))
    return flat.select(*keys, "w", s.cast("long").alias("s"), F.when(F.col("w") == F.col("_n") - 1, F.bround("duration_ms")).otherwise(e).cast("long").alias("e"))
