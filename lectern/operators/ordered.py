"""Rows along an order within keys, for keys of any size: pieces, running sums, folds of small state.

A window over a key puts all its rows into one task. Here rows are dealt by
ranges of (key, order), so a hot key lies in as many pieces as its rows need; what a
piece has to know of those before it is a summary of one row, and only keys that
go on in a further piece have one: there are at most as many as pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import stored


def in_pieces(rows: DataFrame, keys: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """rows with ``piece``: numbers of about equal ranges along (keys, order), nulls first; written once, so that a row keeps its piece.

    Rows that are equal in keys and order share a piece: name a column that tells them apart last.
    """
    n = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys, *order).withColumn("piece", F.spark_partition_id()))


def with_summaries(cut: DataFrame, summaries: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """cut with the columns ``names`` of summaries (keys, piece, names), null where a (key, piece) has none; null keys are equal.

    summaries are at most a row for each piece and border, hence the broadcast.
    """
    s = summaries.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("piece").alias("_piece"), *names)
    same = F.col("piece") == F.col("_piece")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cut.join(F.broadcast(s), same, "left").drop("_piece", *(f"_k{i}" for i in range(len(keys))))


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], pieces: int | None = None) -> DataFrame:
    """rows with each of ``sums`` as a running sum within keys along order, the row itself included; nulls add nothing.

    Sums of pieces, their running sums, then sums within pieces. The order must
    be of distinct rows, else rows that tie are summed in any order.
    """
    cut = in_pieces(rows.withColumns({f"_v_{name}": value for name, value in sums.items()}), keys, order, pieces)
    names = list(sums)
    parts = cut.groupBy(*keys, "piece").agg(*(F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("piece"))
    before = parts.select(*keys, "piece", first.alias("_nth"), *(F.sum(f"_v_{n}").over(earlier).alias(f"_b_{n}") for n in names)).where("_nth > 1")
    inside = Window.partitionBy("piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = with_summaries(cut, before, keys, [f"_b_{n}" for n in names])
    zero = F.lit(0)
    made = summed.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), zero) + F.coalesce(f"_b_{n}", zero) for n in names})
    return made.drop("piece", *(f"_v_{n}" for n in names), *(f"_b_{n}" for n in names))
