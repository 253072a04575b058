"""Every query of the library with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import geometry_plans, planning_plans, reader_plans, reading_stats, source_plans, stream_plans, text_plans, timeline_plans

FLAGSHIP = "J2_A5_per_book"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (reading_stats, text_plans, geometry_plans, planning_plans, reader_plans, source_plans, stream_plans, timeline_plans):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
