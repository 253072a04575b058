"""As-of and interval lookups without theta joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import in_pieces, with_summaries


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, take: list[str], tie: str, or_first: bool = False, pieces: int | None = None) -> DataFrame:
    """left with columns ``take`` of the last row of right whose ``start`` is at most ``at``, per key.

    Both sides are united and dealt by ranges of (key, time), so that a key of any
    size, or any number of rows at one time, lies in as many tasks as it needs;
    no pair of rows is formed. A window carries the last right row along within a
    piece, and the last one of earlier pieces comes over the border. Of right
    rows with equal start the one of largest ``tie`` counts. With ``or_first``,
    left rows before all right rows get the first one; else they get nulls.
    """
    packed = F.struct(F.col(tie).alias("_tie"), *take)
    r = right.select(*by, F.col(start).cast("double").alias("_at"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_order"), packed.alias("_r"), F.lit(None).cast(left_struct(left)).alias("_l"))
    l = left.select(*by, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_order"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    order = ["_at", "_side", "_order"]
    cut = in_pieces(r.union(l), by, order, pieces)
    place = F.when(F.col("_side") == 0, F.struct("_at", "_order"))
    ends = cut.groupBy(*by, "piece").agg(F.max_by("_r", place).alias("_last"), F.min_by("_r", place).alias("_first"))
    along = Window.partitionBy(*by).orderBy("piece")
    borders = ends.select(
        *by, "piece",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    ).where("_before IS NOT NULL OR _after IS NOT NULL")
    known = with_summaries(cut, borders, by, ["_before", "_after"])
    w = Window.partitionBy("piece", *by).orderBy(*order)
    found: Column = F.coalesce(F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    if or_first:
        found = F.coalesce(found, F.first("_r", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.col("_after"))
    return known.withColumn("_found", found).where("_side = 1").select("_l.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def left_struct(df: DataFrame) -> str:
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType.simpleString()


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of closed intervals of whole numbers (lo, hi) and (other_lo, other_hi) of one key that overlap.

    Cells of ``width`` times a power of eight form levels. An interval is at home on
    the first level whose cells are as long as it is, where it touches two cells at most; it
    visits the levels above, two cells each. A pair meets on the higher of both
    homes, in the cell where the later of both begins, so each pair comes once.
    An interval is dealt to a few cells a level whatever its length; the number of levels
    follows from the longest interval. The join is by key, level and cell.

    Edge cases: an interval with a null end, or that ends before it begins, meets nothing; an empty side gives no pair.
    """
    longest = [df.agg(F.max(F.col(hi) - F.col(lo) + 1)).first()[0] or 1 for df, lo, hi in ((left, "lo", "hi"), (right, "other_lo", "other_hi"))]
    levels = 1
    while width * 8 ** (levels - 1) < min(max(longest), 1 << 62):
        levels += 1

    def cells(df, lo, hi, home):
        at = F.lit(levels - 1)
        for level in range(levels - 2, -1, -1):
            at = F.when(F.col(hi) - F.col(lo) < width * 8**level, level).otherwise(at)
        df = df.where(F.col(lo) <= F.col(hi)).withColumn(home, at).withColumn("_level", F.explode(F.sequence(F.col(home), F.lit(levels - 1))))
        size = F.element_at(F.array(*(F.lit(width * 8**k).cast("long") for k in range(levels))), F.col("_level") + 1)
        return df.withColumn("_size", size).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / F.col("_size")), F.floor(F.col(hi) / F.col("_size")))))

    pairs = cells(left, "lo", "hi", "_home").join(cells(right, "other_lo", "other_hi", "_other_home").drop("_size"), [*by, "_level", "_cell"])
    meets = (F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi")) & (F.greatest("_home", "_other_home") == F.col("_level"))
    return pairs.where(meets & (F.floor(F.greatest("lo", "other_lo") / F.col("_size")) == F.col("_cell"))).drop("_cell", "_level", "_size", "_home", "_other_home")
