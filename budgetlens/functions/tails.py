"""Upper tail probabilities as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES = 60  # terms of the error function's series below NEAR, and levels of its continued fraction above
NEAR = 2.0


def erfc(z: Column) -> Column:
    """Complementary error function of ``z >= 0``, to about 1e-14: a series of positive terms near 0, a continued fraction beyond."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), F.struct(z.alias("term"), z.alias("total")), lambda a, k: F.struct(
        (a["term"] * 2 * z * z / (2 * k + 1)).alias("term"), (a["total"] + a["term"] * 2 * z * z / (2 * k + 1)).alias("total")), lambda a: a["total"])
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * terms
    fraction = F.aggregate(F.sequence(F.lit(SERIES), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / 2 / a)
    return F.when(z < NEAR, near).otherwise(F.exp(-z * z) / math.sqrt(math.pi) / fraction)


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) for a chi-square variable with ``dof`` degrees of freedom: a finite series.

    Even degrees: ``e^-h * sum(h^k / k!)`` for k < dof / 2 with h = x / 2; odd degrees: the same with half-integer powers,
    on top of the tail of one degree. Terms are added up from their logarithms, so neither many degrees nor a large
    statistic overflows. Without degrees of freedom or at ``x <= 0`` the tail is 1; null stays null.
    """
    x = x.cast("double")
    h = F.greatest(x, F.lit(1e-300)) / 2
    odd = dof % 2
    # log of the term before the first: the sum of even degrees starts at k = 0, that of odd ones at k = 1/2
    before = F.when(odd == 1, F.log(h) / 2 - h - F.lit(math.lgamma(1.5))).otherwise(-h)
    count = F.floor(dof / 2).cast("int")
    steps = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(before.alias("log"), F.exp(before).alias("total")), lambda a, k: F.struct(
        (a["log"] + F.log(h / (k + odd / 2))).alias("log"), (a["total"] + F.exp(a["log"] + F.log(h / (k + odd / 2)))).alias("total")), lambda a: a["total"])
    tail = F.when(count > 0, total).otherwise(F.lit(0.0)) + F.when(odd == 1, erfc(F.sqrt(h))).otherwise(F.lit(0.0))
    return F.when(x.isNull() | dof.isNull(), F.lit(None).cast("double")).when((dof <= 0) | (x <= 0), F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))
