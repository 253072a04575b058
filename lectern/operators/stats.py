"""Reading-time statistics over sittings, books and reading progress; changes to those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_SITTING_S = 12 * 3600


def time_per_book(sessions: DataFrame, books: DataFrame, progress: DataFrame) -> DataFrame:
    """Seconds and sittings per book, with its title, format and percent read.

    sessions: book_id, duration_s. books: book_id, title, format.
    progress: book_id, percent (at most one row per book). A sitting without
    a book is dropped; a book without progress stands at 0 percent. Sittings
    are summed before the joins, so the shuffle carries one row per book and task.
    """
    per_book = sessions.groupBy("book_id").agg(F.round(F.sum("duration_s"), 2).alias("sec"), F.count(F.lit(1)).alias("n"))
    return (
        per_book.join(books, "book_id")
        .join(progress, "book_id", "left")
        .select("book_id", "title", "format", F.coalesce("percent", F.lit(0)).alias("percent"), "sec", "n")
    )


def clean_sessions(sessions: DataFrame, books: DataFrame, now: Column) -> DataFrame:
    """Sittings fit to be stored: length at most 12 hours, below a second dropped, no end after ``now``, no start after the end, known books only."""
    length = F.least(F.greatest(F.col("duration_s"), F.lit(0.0)), F.lit(float(MOST_SITTING_S)))
    ended = F.least(F.col("ended_at"), now)
    kept = sessions.withColumn("duration_s", length).withColumn("ended_at", ended).withColumn("started_at", F.least("started_at", "ended_at"))
    return kept.where("duration_s >= 1").join(books.select("book_id"), "book_id", "left_semi")


def daily(sessions: DataFrame, as_of: str, days: int) -> DataFrame:
    """Seconds for each of the last ``days`` days, days without a sitting too."""
    series = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))).alias("day"))
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    sums = sessions.where((F.to_date("ended_at") >= first) & (F.to_date("ended_at") <= F.lit(as_of).cast("date"))).groupBy(F.to_date("ended_at").alias("day")).agg(F.sum("duration_s").alias("sec"))
    return series.join(sums, "day", "left").select("day", F.round(F.coalesce("sec", F.lit(0.0)), 2).alias("sec"))


def streaks(sessions: DataFrame, as_of: str) -> DataFrame:
    """(book_id, streak): days in a row with a sitting, up to as_of, or to the day before if that one has none."""
    days = sessions.select("book_id", F.to_date("ended_at").alias("day")).where(F.col("day") <= F.lit(as_of).cast("date")).distinct()
    island = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy("book_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("book_id", "island").agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("n"))
    live = F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), 1)
    return runs.groupBy("book_id").agg(F.coalesce(F.max(F.when(live, F.col("n"))), F.lit(0)).alias("streak"))


def global_streak(sessions: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: days in a row with any sitting, within the last ``days``, up to as_of, or to the day before if that one has none.

    What meets in one place is a row for each of those days.
    """
    last = F.lit(as_of).cast("date")
    recent = sessions.where((F.to_date("ended_at") > F.date_sub(last, days)) & (F.to_date("ended_at") <= last)).select(F.lit(0).alias("book_id"), "ended_at")
    return streaks(recent, as_of).agg(F.coalesce(F.max("streak"), F.lit(0)).alias("streak"))


def by_state(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Books finished, being read and unread: always three rows."""
    percent = F.coalesce("percent", F.lit(0))
    state = F.when(percent >= 100, "finished").when(percent > 0, "reading").otherwise("unread")
    counts = books.join(progress, "book_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    names = books.sparkSession.createDataFrame([("finished",), ("reading",), ("unread",)], "state string")
    return names.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key: an upsert over a log of changes, with partial aggregation before the shuffle."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def delete_cascading(parent_ids: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Each child table without the rows of deleted parents."""
    return {name: child.join(parent_ids, key, "left_anti") for name, child in children.items()}


def merge_partial(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's non-null values, and new's rows of unknown keys."""
    rest = [c for c in old.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"_{c}") for c in rest])
    return old.join(renamed, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


def hue_vote(samples: DataFrame, bins: int = 24, least_share: float = 0.1) -> DataFrame:
    """(book, hue): winning hue of a book's colour samples (book, h, s, l).

    Hues fall into bins; grey, near-black and near-white samples don't vote but
    count in the total. A bin is judged with half of each neighbour around the
    circle; the winner and both neighbours give the circular mean, or null if
    they hold less than least_share of all samples.
    """
    votes = (F.col("s") >= 0.12) & (F.col("l") > 0.05) & (F.col("l") < 0.95)
    weight = F.when(votes, F.col("s") * (1 - F.abs(F.col("l") - 0.33))).otherwise(0.0)
    binned = samples.withColumn("w", weight).withColumn("votes", votes).withColumn("bin", (F.floor(F.col("h") / (360 / bins)) % bins).cast("int"))
    # Each sample votes in its own bin and, as a neighbour, in two others.
    spread = binned.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("bin", F.pmod(F.col("bin") + F.col("d"), F.lit(bins)))
    angle = F.radians("h")
    scored = spread.groupBy("book", "bin").agg(
        F.sum(F.col("w") * F.when(F.col("d") == 0, 1.0).otherwise(0.5)).alias("score"), F.count_if("votes").alias("n"),
        F.sum(F.col("w") * F.sin(angle)).alias("y"), F.sum(F.col("w") * F.cos(angle)).alias("x"),
    )
    total = samples.groupBy("book").agg(F.count(F.lit(1)).alias("total"))
    best = scored.groupBy("book").agg(F.max_by(F.struct("n", "x", "y"), F.struct(F.round("score", 6), -F.col("bin"))).alias("b"))
    hue = F.pmod(F.degrees(F.atan2("b.y", "b.x")), F.lit(360.0))
    return best.join(total, "book").select("book", F.when((F.col("b.n") >= least_share * F.col("total")) & (F.col("b.n") > 0), F.round(hue)).cast("int").alias("hue"))
