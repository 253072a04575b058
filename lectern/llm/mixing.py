"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, passing

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Relative weight over training time, as (time, height) knots; repeats like WEIGHTS.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
SHARE = 1.5
MOST = 2


def time_of(demand: str, knots) -> str:
    """SQL for the time at which a schedule has asked for ``demand`` (a share, 0 to 1) of its whole.

    The schedule is linear between knots; its integral is quadratic there and
    is inverted in closed form.
    """
    areas = [(t1 - t0) * (h0 + h1) / 2 for (t0, h0), (t1, h1) in zip(knots, knots[1:])]
    whole, before, out = sum(areas), 0.0, []
    for ((t0, h0), (t1, h1)), area in zip(zip(knots, knots[1:]), areas):
        slope = (h1 - h0) / (t1 - t0)
        rest = f"({demand} * {whole!r}D - {before!r}D)"
        out.append((before + area, f"{t0!r}D + 2.0D * {rest} / ({h0!r}D + sqrt({h0 * h0!r}D + {2 * slope!r}D * {rest}))"))
        before += area
    cases = "".join(f" WHEN {demand} * {whole!r}D < {end!r}D THEN {form}" for end, form in out[:-1])
    return f"(CASE{cases} ELSE {out[-1][1]} END)" if cases else f"({out[-1][1]})"


@passing("doc_id", "text", "source")
def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs (with doc_id, text, source) and what the mix takes of each row.

    Adds size (words, ``[^\\x20\\x09-\\x0D]+``; a null text has none), source_size,
    target (words the mix takes of the row's source), taken, position and
    position_again (training time, 0 to 1, of the first and the second pass
    over the row; null if that pass takes nothing).

    Targets: the integral of each source's schedule shares ``share`` times all
    sizes; a target stops at ``most`` times its source's size and the excess is
    shared by weight among the rest. Taking: a source's rows stand in the order
    of the md5 of their doc_id; the mix takes the first floor(target) words of
    that row order, read round and round, so the sum of taken is floor(target)
    and no row gives more than ``most`` times its size. The running sums are
    split by a prefix of the md5, so no task holds a whole source: a hot source
    only has more prefixes' worth of rows. Only (source, prefix) sums meet per source.

    Edge cases: null source is a source of its own, ordered last; null or empty
    texts have size 0 and taken 0; a source of empty texts has target 0; rows
    with equal doc_id are taken one after another in the order of their texts'
    hash, equal rows are interchangeable; an empty table gives an empty result;
    any other columns pass through, but the names added here are replaced.
    """
    added = ("size", "source_size", "target", "taken", "position", "position_again")
    docs = docs.drop(*added)
    digits = max(1, min(6, math.ceil(math.log(max(docs.count(), 1) / 1500 + 1, 16))))
    rows = docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    rows = rows.withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_part", F.substring("_md5", 1, digits))
    rows = rows.withColumn("_source", F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), "source")))
    parts = rows.groupBy("_source", "_part").agg(F.sum("size").alias("_sum"))
    whole = Window.partitionBy("_source")
    parts = parts.select(
        "_source", "_part",
        (F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"),
    )
    sources = _targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # One row per source: each part row carries its source's target on.
    parts = parts.join(sources, "_source")
    inside = Window.partitionBy("_source", "_part").orderBy("_md5", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(parts, ["_source", "_part"])
        .withColumn("_at", F.col("_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("_goal", F.floor("target"))
        .withColumn("_first", F.expr("greatest(0L, least(size, _goal - _at))"))
        .withColumn("_second", F.expr("greatest(0L, least(size, _goal - source_size - _at))"))
        .withColumn("taken", F.col("_first") + F.col("_second"))
        .withColumn("position", _position("_first", "_at", schedules, len(weights)))
        .withColumn("position_again", _position("_second", "_at + source_size", schedules, len(weights)))
        .drop("_source", "_part", "_md5", "_before", "_at", "_goal", "_first", "_second", "_slot", "_tie")
    )


def _position(taken: str, at: str, schedules, slots: int):
    demand = f"(CAST({at} AS DOUBLE) / target)"
    cases = " ".join(f"WHEN _slot = {i} THEN {time_of(demand, schedules[i % len(schedules)])}" for i in range(slots))
    return F.expr(f"CASE WHEN {taken} > 0 THEN CASE {cases} END END")


def _targets(sources: DataFrame, weights, share: float, most: int) -> DataFrame:
    """One row per source with its slot and target; one row per source is all that meets in one task.

    Sources fill up in the order of cap / weight: a source is capped if its cap
    is below its share of what the sources before it leave.
    """
    by_name = Window.orderBy("_source")
    # "=" sorts before "~": null is last, the rest are in code-point order.
    named = sources.withColumn("_slot", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_slot") + 1)
    named = named.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * most)
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    filled = named.withColumn("_left", left).withColumn("_wleft", weight_left)
    filled = filled.withColumn("_full", F.col("_cap") * F.col("_wleft") <= F.col("_left") * F.col("_w"))
    # The first source that isn't full fixes what all later ones get for their weight.
    rest = filled.withColumn("_l", F.max(F.when(~F.col("_full"), F.col("_left"))).over(everything)).withColumn(
        "_wl", F.max(F.when(~F.col("_full"), F.col("_wleft"))).over(everything)
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_l") * F.col("_w") / F.col("_wl"))
    return rest.select("_source", "_slot", "source_size", target.alias("target"))


@passing("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, a row of two passes twice, range-sorted by training position.

    Columns and texts are those of docs. A pass that takes only the first words
    of a row (at most one row for each source and pass) gives the whole row.

    Edge cases: those of plan_mix; null and empty texts have no words, so the
    mix never takes them; equal rows come as often as they are taken; an empty table stays empty.
    """
    names = docs.columns
    passes = F.array_compact(F.array("position", "position_again"))
    planned = plan_mix(docs, **options).select(*names, F.explode(passes).alias("_position"))
    return planned.orderBy("_position", "doc_id").drop("_position")
