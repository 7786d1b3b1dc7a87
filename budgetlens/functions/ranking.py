"""Exact global order statistics without an unpartitioned window on a big table.

``prefix_sums`` takes a frame with ONE row per distinct ordering value (aggregate
first - that collapses tied or hot values to one row), cuts the ordering range
into buckets by approximate quantiles of that distinct set, takes per-bucket
totals (a tiny table), turns them into offsets, and finishes with a window
partitioned by bucket: about as many as there are shuffle partitions, at every size.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES_PER_BUCKET = 100

def _bucket_col(df: DataFrame, bucket_by: str, buckets: int) -> DataFrame:
    """Adds ``_bk``: ranges of the ordering column, always, one for each shuffle partition or so.

    Numbers are cut at approximate quantiles; other types (string keys) at the quantiles of a sample of their values.
    """
    if isinstance(df.schema[bucket_by].dataType, T.NumericType):
        probs = [i / buckets for i in range(1, buckets)]
        edges = df.agg(F.percentile_approx(F.col(bucket_by).cast("double"), probs, max(10_000, 10 * buckets)).alias("e")).first()["e"] if probs else []
        splits = [-math.inf, *sorted({float(e) for e in edges or [] if e is not None and not math.isinf(e)}), math.inf]
        if len(splits) == 2:
            return df.withColumn("_bk", F.lit(0))
        tmp = df.withColumn("_bkv", F.col(bucket_by).cast("double"))
        out = Bucketizer(splits=splits, inputCol="_bkv", outputCol="_bkd", handleInvalid="keep").transform(tmp)
        return out.withColumn("_bk", F.coalesce(F.col("_bkd").cast("int"), F.lit(-1))).drop("_bkv", "_bkd")
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / max(1, df.count()))
    drawn = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(bucket_by), F.lit(1 << 30)) < int(share * (1 << 30))).select(bucket_by).dropna().collect())
    cuts = sorted({drawn[len(drawn) * k // buckets] for k in range(1, buckets)}) if drawn else []

    def above(lo: int, hi: int) -> Column:  # binary search: a row meets the logarithm of the borders, not all
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(bucket_by) <= F.lit(cuts[mid]), above(lo, mid)).otherwise(above(mid + 1, hi))

    return df.withColumn("_bk", F.when(F.col(bucket_by).isNull(), F.lit(-1)).otherwise(above(0, len(cuts))))


def prefix_sums(
    df: DataFrame,
    order_cols: Sequence[str],
    sum_cols: Sequence[str],
    part_cols: Sequence[str] = (),
    descending: bool = False,
    bucket_by: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum) for each ``c`` in ``sum_cols``.

    ``order_cols`` must be unique within ``part_cols``; ``bucket_by`` is a
    column monotone in that order (defaults to the first order column).
    """
    bucket_by = bucket_by or order_cols[0]
    bdf = _bucket_col(df, bucket_by, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if descending:
        bdf = bdf.withColumn("_bk", -F.col("_bk"))
        orders = [F.col(c).desc() for c in order_cols]
    else:
        orders = [F.col(c).asc() for c in order_cols]
    inner = Window.partitionBy(*part_cols, "_bk").orderBy(*orders).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bdf.select("*", *[F.sum(c).over(inner).alias(f"_in_{c}") for c in sum_cols])
    tot = bdf.groupBy(*part_cols, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])  # one row a part and bucket
    wb = Window.partitionBy(*part_cols).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part_cols, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    out = out.join(offs, [*part_cols, "_bk"])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_in_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sum_cols],
    )


def hash_order_key(key: str | F.Column, seed: int) -> tuple[F.Column, F.Column]:
    """Seeded pseudo-random order shared with SQL: ``md5(key || seed)``.

    Returns (full md5 text for ordering, 60-bit numeric prefix for bucketing).
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(str(seed))))
    return h, F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def row_numbers(df: DataFrame, order_cols: Sequence[str], part_cols: Sequence[str] = (),
                bucket_by: str | None = None, descending: bool = False, name: str = "rn") -> DataFrame:
    """Exact ``row_number()`` (1-based) over a unique ordering, computed distributed."""
    tmp = df.withColumn("_one", F.lit(1).cast("long"))
    out = prefix_sums(tmp, order_cols, ["_one"], part_cols, descending, bucket_by)
    return out.withColumnRenamed("cum__one", name).drop("_one")
