"""Exact quantiles (linear interpolation, as pandas / numpy / DuckDB ``quantile_cont``).

Spark's exact ``percentile`` merges a value->count map of the whole group in one
task, which does not survive a group with billions of distinct values. Here every
rank is selected in rounds, all groups, columns and probabilities at once:

1. one aggregation counts the values of each group and column; each probability
   becomes a target: two ranks and a bracket ``[lo, hi]``, at first without borders;
2. while a bracket may hold more than MOST values between its borders, one aggregation
   counts what lies below, at, between and above its borders and sketches what lies
   between; the bracket shrinks to the sketch's cells around its ranks. If the sketch
   misled (counts are exact, so this is seen in the next round), the search goes on in
   the verified rest beside it. Every round shrinks the verified bracket;
3. one aggregation collapses the rows below and above a bracket to a counter each and
   the rest to one row a value; a window over those rows, at most MOST of them and the
   borders at any size of the data, picks the values at ranks ``floor(p (n-1))`` and
   ``ceil(p (n-1))`` and interpolates.

Without groups, ``_in_two_passes`` comes first: one aggregation sketches all columns side by side, one pass (numpy over
Arrow batches) counts what lies below and at the borders of every sketched bracket and hands on the few values between
them. The counts are exact, so a bracket that misses its ranks or holds more than MOST values is seen; then the rounds
above do the work.

Targets that share a bracket share its counts and its window. Bracket tables (groups x
columns x probs) are broadcast only when their counted rows fit the session's broadcast
threshold. A hot value is one row of a window, however many rows share it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

DEFAULT_ACCURACY = 10_000
MOST = 100_000  # values between the borders of a bracket that one window may sort; at least 4, so that a round's four cells or so are less than all
BRACKETS = 1000  # columns x probs that one pass over the rows compares
ROW_BYTES = 16 * 12  # an unsafe row of a bracket: keys, ranks and borders


def to_long(df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """``(group..., column, v)`` with NULL values removed."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in value_cols])
    return df.select(*group_cols, F.inline(arr)).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def _targets(long: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """One row a key and probability: ranks, an open bracket, and ``inner``, a bound on the values between its borders."""
    rows = []
    for j, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        rows.append(F.struct(F.lit(j).alias("pj"), F.lit(float(p)).alias("prob"), F.floor(pos).cast("long").alias("r0"),
                             F.ceil(pos).cast("long").alias("r1"), (pos - F.floor(pos)).alias("frac")))
    ends = [F.lit(sign * math.inf).alias(name) for sign, name in ((-1, "lo"), (1, "hi"), (-1, "outer_lo"), (1, "outer_hi"))]
    sizes = long.groupBy(*keys).agg(F.count("v").alias("n"))
    return sizes.select(*keys, F.col("n").alias("inner"), F.inline(F.array(*rows))).select("*", *ends)


def _beside(long: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Every value beside the brackets of its key."""
    brackets = targets.select(*keys, "lo", "hi").distinct()
    return long.join(F.broadcast(brackets) if _small(targets) else brackets, keys)


def _narrow(long: DataFrame, keys: list[str], targets: DataFrame, accuracy: int) -> DataFrame:
    """One round of step 2 for the given targets."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    cells = max(16, accuracy // 10)
    between = (v > lo) & (v < hi)
    counts = _beside(long, keys, targets).groupBy(*keys, "lo", "hi").agg(
        F.count_if(v < lo).alias("_below"), F.count_if(v == lo).alias("_at_lo"), F.count_if(between).alias("_between"),
        F.count_if((v == hi) & (hi > lo)).alias("_at_hi"), F.percentile_approx(F.when(between, v), [i / cells for i in range(cells + 1)], accuracy).alias("_cells"))
    first, size = F.col("_below") + F.col("_at_lo"), F.col("_between")  # ranks before those between the borders
    under, over = F.col("r0") < F.col("_below"), F.col("r1") >= first + size + F.col("_at_hi")
    found = ~under & ~over & (size <= F.lit(MOST))
    # ranks of values that equal a border lie outside the cells
    left = F.least(F.floor((F.col("r0") - first) / size * cells) - 1, F.lit(cells)).cast("int")
    right = F.greatest(F.ceil((F.col("r1") - first + 1) / size * cells) + 1, F.lit(0)).cast("int")
    new_lo = F.when(under, F.col("outer_lo")).when(over, hi).when(found | (left <= 0), lo).otherwise(F.get("_cells", left))
    new_hi = F.when(under, lo).when(over, F.col("outer_hi")).when(found | (right >= cells), hi).otherwise(F.get("_cells", right))
    missed = under | over
    return targets.drop("inner").join(counts, [*keys, "lo", "hi"]).select(
        *keys, F.when(found, size).alias("inner"), "pj", "prob", "r0", "r1", "frac", new_lo.alias("lo"), new_hi.alias("hi"),
        F.when(missed, F.when(under, F.col("outer_lo")).otherwise(hi)).otherwise(lo).alias("outer_lo"),
        F.when(missed, F.when(under, lo).otherwise(F.col("outer_hi"))).otherwise(hi).alias("outer_hi"))


def _small(br: DataFrame) -> bool:
    """Whether the (checkpointed) bracket table fits the session's broadcast threshold, by its counted rows."""
    limit = br.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return br.count() * ROW_BYTES <= limit


def _solve(long: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Step 3: (keys, pj, prob, frac, v0, v1)."""
    side = F.when(F.col("v") < F.col("lo"), 0).when(F.col("v") > F.col("hi"), 2).otherwise(1)
    counted = (
        _beside(long, keys, targets).select(*keys, "lo", "hi", side.alias("_side"), F.when(side == 1, F.col("v")).alias("_v"))
        .groupBy(*keys, "lo", "hi", "_side", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*keys, "lo", "hi").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counted.withColumn("_cum", F.sum("_c").over(w)).withColumn("_prev", F.col("_cum") - F.col("_c"))
    at = lambda r: (F.col("_prev") <= F.col(r)) & (F.col(r) < F.col("_cum"))
    return cum.join(targets, [*keys, "lo", "hi"]).where(at("r0") | at("r1")).groupBy(*keys, "pj", "prob", "frac").agg(
        F.max(F.when(at("r0"), F.col("_v"))).alias("v0"), F.max(F.when(at("r1"), F.col("_v"))).alias("v1"))


PENDING = 1 << 18  # values between borders that a task gathers before it hands them on


def _sketched(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int) -> list[tuple]:
    """(column, prob, rows, lo, hi) of every column with values: the sketch's values two of its errors beside the rank."""
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-2 / accuracy, 2 / accuracy)])
    values = [F.when(~F.isnan(v), v) for v in (F.col(c).cast("double") for c in cols)]
    row = df.agg(*[F.count(v).alias(f"n{j}") for j, v in enumerate(values)], *[F.percentile_approx(v, ends, accuracy).alias(f"e{j}") for j, v in enumerate(values)]).first()
    return [(j, i, row[f"n{j}"], *row[f"e{j}"][2 * i : 2 * i + 2]) for j in range(len(cols)) if row[f"n{j}"] for i in range(len(probs))]


def _in_two_passes(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame | None:
    """(column, prob, frac, v0, v1), or None if a bracket misses its ranks or holds too much."""
    found = _sketched(df, cols, probs, accuracy)
    if not found or max(n for _, _, n, _, _ in found) * 5 > MOST * accuracy:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, at_lo, at_hi = (np.zeros(len(found), np.int64) for _ in range(3))
        inner: list[list] = [[] for _ in found]

        def rows(b, side, v, c):
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(side, pa.int32()), pa.array(v, pa.float64()), pa.array(c, pa.int64())], names=["b", "side", "v", "c"])

        def between():
            each = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0), np.zeros(0, np.int64)) for x in inner]
            sizes = [len(v) for v, _ in each]
            return rows(np.repeat(np.arange(len(found)), sizes), np.ones(sum(sizes), int), np.concatenate([v for v, _ in each]), np.concatenate([c for _, c in each]))

        for batch in batches:
            x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(cols))]  # missing values are NaN: beside every border
            for i, (j, _, _, lo, hi) in enumerate(found):
                v = x[j]
                below[i] += np.count_nonzero(v < lo)
                at_lo[i] += np.count_nonzero(v == lo)
                if hi > lo:
                    at_hi[i] += np.count_nonzero(v == hi)
                    inner[i].append(v[(v > lo) & (v < hi)])
            if sum(len(v) for one in inner for v in one) > PENDING:
                yield between()
                inner = [[] for _ in found]
        yield between()
        for side, ends, c in ((0, [-math.inf] * len(found), below), (1, [f[3] for f in found], at_lo), (1, [f[4] for f in found], at_hi)):
            on = np.flatnonzero(c)
            yield rows(on, np.full(len(on), side), np.array(ends, float)[on], c[on])

    values = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(f"x{k}") for k, c in enumerate(cols)])
    counted = values.mapInArrow(count, "b int, side int, v double, c long").groupBy("b", "side", "v").agg(F.sum("c").alias("_c")).checkpoint()
    sizes = {r.b: r for r in counted.groupBy("b").agg(F.sum(F.when(F.col("side") == 0, F.col("_c")).otherwise(0)).alias("below"),
                                                     F.sum(F.when(F.col("side") == 1, F.col("_c")).otherwise(0)).alias("within"), F.count_if(F.col("side") == 1).alias("values")).collect()}
    targets = []
    for b, (j, i, n, _, _) in enumerate(found):
        pos = (n - 1) * float(probs[i])
        r0, r1 = math.floor(pos), math.ceil(pos)
        if b not in sizes or not (sizes[b].below <= r0 and r1 < sizes[b].below + sizes[b].within and sizes[b].values <= MOST + 2):
            return None
        targets.append((b, cols[j], float(probs[i]), pos - r0, r0, r1))
    known = df.sparkSession.createDataFrame(targets, "b int, column string, prob double, frac double, r0 long, r1 long")
    w = Window.partitionBy("b").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counted.withColumn("_cum", F.sum("_c").over(w)).join(F.broadcast(known), "b")  # columns x probs
    at = lambda r: (F.col("_cum") - F.col("_c") <= F.col(r)) & (F.col(r) < F.col("_cum"))
    return cum.where(at("r0") | at("r1")).groupBy("column", "prob", "frac").agg(F.max(F.when(at("r0"), F.col("v"))).alias("v0"), F.max(F.when(at("r1"), F.col("v"))).alias("v1"))


def exact_quantiles(
    df: DataFrame,
    value_cols: Sequence[str],
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """Long ``(group..., column, prob, q)``: exact linear-interpolated quantiles.

    Groups or columns with no non-NULL value, and rows without a group, are absent from the result.
    ``accuracy`` is the sketch's; it bears on the number of rounds only, never on the result.
    """
    if accuracy < 20 or MOST < 4:
        raise ValueError("brackets shrink reliably from an accuracy of 20 and windows of 4 values on")
    keys = [*group_cols, "column"]
    checkpoint_dir(df.sparkSession)
    res = _in_two_passes(df, list(value_cols), probs, accuracy) if not group_cols and len(value_cols) * len(probs) <= BRACKETS else None
    res = (_in_rounds(to_long(df, value_cols, group_cols), keys, probs, accuracy) if res is None else res).checkpoint()
    # equal values need no difference: that of two infinities is not a number
    between = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0")))
    return res.select(*keys, "prob", between.alias("q"))


def _in_rounds(long: DataFrame, keys: list[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """(keys, pj, prob, frac, v0, v1) by steps 1 to 3."""
    # targets are small (groups x columns x probs); reliable checkpoints leave no cache behind
    targets = _targets(long, keys, probs).checkpoint()
    while not (active := targets.where(F.col("inner").isNull() | (F.col("inner") > MOST))).isEmpty():
        rest = targets.where(F.col("inner") <= MOST)
        targets = rest.unionByName(_narrow(long, keys, active, accuracy)).checkpoint()
    return _solve(long, keys, targets)


def quantile_values(df: DataFrame, col: str, probs: Sequence[float], accuracy: int = DEFAULT_ACCURACY) -> list[float | None]:
    """Driver-side list of exact quantiles of one column (the fit step of a transform)."""
    rows = exact_quantiles(df, [col], probs, accuracy=accuracy).collect()
    by_p = {round(r["prob"], 12): r["q"] for r in rows}
    return [by_p.get(round(float(p), 12)) for p in probs]


def quantile_map(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """``{(column, prob): q}`` for a few columns, computed in one distributed pass."""
    rows = exact_quantiles(df, cols, probs).collect()
    return {(r["column"], round(r["prob"], 12)): r["q"] for r in rows}


def quantile_wide(df: DataFrame, value_cols: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = (),
                  names: Sequence[str] | None = None) -> DataFrame:
    """One row per (group, column) with one column per prob (named ``names`` or ``p<pct>``)."""
    names = list(names or [f"p{round(p * 100, 4):g}".replace(".", "_") for p in probs])
    q = exact_quantiles(df, value_cols, probs, group_cols)
    keys = [*group_cols, "column"]
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.abs(F.col("prob") - float(p)) < 1e-12, F.col("q"))).alias(nm) for p, nm in zip(probs, names)]
    )
