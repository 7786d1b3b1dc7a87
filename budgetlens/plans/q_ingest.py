"""Queries for ingest, roll-up and the unit build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..spec import STANDIN_SPEC
from .common import UNIT_DOUBLES2, UNIT_DOUBLES6, rounded, rsql
from .registry import register
from .sqlviews import with_units
from .tables import raw_table, units_table


@register("a06_build_units", sql=with_units(rsql("SELECT * FROM units", UNIT_DOUBLES6, UNIT_DOUBLES2)))
def a06_build_units(spark, sf):
    return rounded(ingest.build_units(raw_table(spark, sf), STANDIN_SPEC))


@register(
    "a07_build_counters",
    sql=with_units(rsql(
        """SELECT (SELECT count(*) FROM raw) AS n_raw,
                  (SELECT count(*) FROM raw) - (SELECT count(*) FROM units) AS n_dropped,
                  (SELECT count(*) FROM units) AS n_kept,
                  (SELECT avg(target) FROM units) AS target_rate""", "target_rate")),
)
def a07_build_counters(spark, sf):
    return rounded(ingest.build_counters(raw_table(spark, sf), STANDIN_SPEC))


@register(
    "e10_rate_by_area",
    sql=with_units(rsql(
        """SELECT area, avg(target) AS rate, count(*) AS n FROM units
           WHERE area IS NOT NULL GROUP BY area""", "rate")),
)
def e10_rate_by_area(spark, sf):
    from ..operators.profile import rate_by_group

    return rounded(rate_by_group(units_table(spark, sf), "area", "target"))
