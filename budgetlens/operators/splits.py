"""Seeded samples, folds and hold-out splits that are reproducible in SQL.

Randomness is a seeded hash of the unit key (``md5(key || seed)``), so the same
assignment can be written in any engine and does not depend on partitioning
or on task retries (a lost executor recomputes identical folds).
Row numbers over the hash order are exact and distributed
(``functions.ranking.row_numbers``): a class holding a third of all rows is cut
into hash-range buckets, never sent to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HOLDOUT_FRACTION, N_FOLDS, SEED
from ..functions.ranking import hash_order_key, row_numbers


def _with_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    h, hn = hash_order_key(key, seed)
    return df.withColumn("_h", h).withColumn("_hn", hn)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows in seeded hash order (C5). ``limit`` is the feature: a bounded sample."""
    h, _ = hash_order_key(key, seed)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def seeded_pairs(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` row pairs: the i-th row of one seeded sample with the i-th of another."""
    a = seeded_sample(df, key, n, seed)
    b = seeded_sample(df, key, n, seed + 1)
    ha, _ = hash_order_key(key, seed)
    hb, _ = hash_order_key(key, seed + 1)
    ra = a.withColumn("pair", F.row_number().over(Window.orderBy(ha, key)))
    rb = b.withColumn("pair", F.row_number().over(Window.orderBy(hb, key)))
    cols = [c for c in df.columns]
    return ra.select("pair", *[F.col(c).alias(f"{c}_i") for c in cols]).join(
        rb.select("pair", *[F.col(c).alias(f"{c}_j") for c in cols]), "pair")


def random_score_col(key: str, seed: int = SEED):
    """Seeded uniform score in [0, 1): the first 13 hex digits of the hash / 2^52 (exact in a DOUBLE)."""
    h, _ = hash_order_key(key, seed)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def random_score(df: DataFrame, key: str, seed: int = SEED, name: str = "random_score") -> DataFrame:
    """Seeded uniform score per row."""
    return df.withColumn(name, random_score_col(key, seed))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = N_FOLDS, seed: int = SEED,
                     name: str = "fold") -> DataFrame:
    """Fold id = (row number within class in hash order - 1) mod k.

    Every fold gets the class counts within one of each other, as stratified
    k-fold does.
    """
    d = _with_hash(df, key, seed)
    d = row_numbers(d, ["_h"], part_cols=[label], bucket_by="_hn", name="_rn")
    return d.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_h", "_hn", "_rn")


def stratified_holdout(df: DataFrame, key: str, label: str, fraction: float = HOLDOUT_FRACTION,
                       seed: int = SEED, name: str = "is_test") -> DataFrame:
    """Per class, the first ``ceil(fraction * n_class)`` rows in hash order are the test set."""
    d = _with_hash(df, key, seed)
    d = row_numbers(d, ["_h"], part_cols=[label], bucket_by="_hn", name="_rn")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    d = d.join(F.broadcast(counts), label)  # one row per class
    test = F.col("_rn") <= F.ceil(F.col("_nc") * F.lit(float(fraction)))
    return d.withColumn(name, test.cast("int")).drop("_h", "_hn", "_rn", "_nc")


def class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` attached per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    cw = counts.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(name))
    return df.join(F.broadcast(cw), label)  # one row per class


def disjoint_parts(df: DataFrame, key: str, k: int = 5, seed: int = SEED, name: str = "part") -> DataFrame:
    """``ntile(k)`` over the seeded hash order: k contiguous parts, the first ones one row larger."""
    d = _with_hash(df, key, seed)
    n = df.count()
    d = row_numbers(d, ["_h"], bucket_by="_hn", name="_rn")
    q, r = divmod(n, k)
    rn = F.col("_rn")
    big = F.lit(r * (q + 1))
    part = F.when(rn <= big, F.floor((rn - 1) / F.lit(q + 1))).otherwise(
        F.lit(r) + F.floor((rn - 1 - big) / F.lit(max(q, 1))))
    return d.withColumn(name, (part + 1).cast("int")).drop("_h", "_hn", "_rn")
