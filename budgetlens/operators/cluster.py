"""Clustering into personas and its validity checks.

K-means is in ``kmeans``; the checks (ARI, chi-square, Cramer's V, silhouette) are
plain aggregations over contingency tables or over a bounded seeded sample.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED, SILHOUETTE_SAMPLE
from ..functions.tails import chi_square_tail
from .splits import seeded_sample


def _c2(x):
    return x * (x - 1) / 2.0


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = cells.cube(a, b).agg(F.sum("n").alias("n"), F.grouping_id().alias("by"))  # 0: cells, 1: by a, 2: by b, 3: all
    pick = lambda by, x: F.sum(F.when(F.col("by") == by, x))
    t = sums.agg(pick(0, _c2(F.col("n"))).alias("sij"), pick(1, _c2(F.col("n"))).alias("si"), pick(2, _c2(F.col("n"))).alias("sj"), pick(3, F.col("n")).alias("N"))
    expected = F.col("si") * F.col("sj") / _c2(F.col("N"))
    mx = (F.col("si") + F.col("sj")) / 2
    return t.select(F.when(mx - expected == 0, F.lit(1.0)).otherwise((F.col("sij") - expected) / (mx - expected)).alias("ari"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square of independence, degrees of freedom and Cramer's V.

    Yates' correction applies only to 2 x 2 tables, as in the usual test.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    w_all = Window.partitionBy()
    e = cells.withColumn("ra", F.sum("o").over(Window.partitionBy(a))).withColumn("cb", F.sum("o").over(Window.partitionBy(b))) \
        .withColumn("N", F.sum("o").over(w_all))
    # the contingency table has (levels of a) x (levels of b) cells: small by construction
    e = e.withColumn("e", F.col("ra") * F.col("cb") / F.col("N"))
    dims = cells.agg(F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    return _chi_finish(e, dims)


def _chi_finish(e: DataFrame, dims: DataFrame) -> DataFrame:
    """Sum over ALL r x c cells: observed cells from the table, empty cells contribute their expected count.

    Empty cells are absent from a grouped count; each adds (0 - e)^2 / e = e, and the
    expected counts of all cells sum to N, so the empty cells add N - sum(e over observed).
    For a 2 x 2 table (Yates) the at most four cells are enumerated exactly.
    """
    d = dims.first()
    r, c = int(d["r"]), int(d["c"])
    k = min(r, c) - 1
    if r == 2 and c == 2:
        cells = e.select("o", "e", "ra", "cb", "N").collect()  # at most 4 rows
        n = cells[0]["N"]
        chi2 = 0.0
        seen = 0
        for x in cells:
            dev = max(abs(x["o"] - x["e"]) - 0.5, 0.0)
            chi2 += dev * dev / x["e"]
            seen += 1
        # empty cells of a 2 x 2 table: expected counts from the margins of the present cells
        missing = 4 - seen
        if missing:
            tot_e = sum(x["e"] for x in cells)
            chi2 += sum([max(v - 0.5, 0.0) ** 2 / v for v in [(n - tot_e) / missing] * missing])
        return e.limit(1).select(F.lit(chi2).alias("chi2"), F.lit(1).alias("dof"),
                                 F.sqrt(F.lit(chi2) / F.col("N")).alias("cramers_v"))
    dev = F.col("o") - F.col("e")
    agg = e.agg((F.sum(dev * dev / F.col("e")) + (F.first("N") - F.sum("e"))).alias("chi2"), F.first("N").alias("N"))
    return agg.select("chi2", F.lit((r - 1) * (c - 1)).alias("dof"),
                      F.sqrt(F.col("chi2") / (F.col("N") * F.lit(max(k, 1)))).alias("cramers_v"))


def with_p_value(test: DataFrame) -> DataFrame:
    """Add the p-value of a ``chi_square`` result."""
    return test.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof")))


def silhouette(df: DataFrame, cols: Sequence[str], label: str, key: str, n: int = SILHOUETTE_SAMPLE,
               seed: int = SEED, partitions: int = 8) -> DataFrame:
    """Euclidean silhouette on a seeded sample of at most ``n`` rows.

    The score is defined on a bounded sample (``n`` is the feature), so the
    sample's coordinates (n x d doubles) are a proven-small broadcast. Each task
    takes a slice of the sample and computes, with numpy, every point's mean
    distance to each cluster - no pair rows are ever emitted. A singleton
    cluster scores 0.
    """
    import numpy as np
    import pandas as pd

    s = seeded_sample(df.select(key, label, *cols).na.drop(subset=list(cols)), key, n, seed)
    local = s.toPandas()  # bounded by n rows
    pts = local[list(cols)].to_numpy(dtype=float)
    labs = local[label].to_numpy()
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((pts, labs))
    cols_l = list(cols)

    def score(batches):
        allp, alll = bc.value
        uniq = np.unique(alll)
        sizes = {u: int((alll == u).sum()) for u in uniq}
        for b in batches:
            x_all = b[cols_l].to_numpy(dtype=float)
            own_all = b[label].to_numpy()
            out = np.zeros(len(b))
            for lo in range(0, len(b), 256):  # bounded memory: 256 x n distances at a time
                x, own = x_all[lo:lo + 256], own_all[lo:lo + 256]
                d = np.sqrt(((x[:, None, :] - allp[None, :, :]) ** 2).sum(axis=2))
                means = {u: d[:, alll == u].sum(axis=1) for u in uniq}
                for r in range(len(x)):
                    sz = sizes[own[r]]
                    if sz <= 1 or len(uniq) < 2:
                        continue
                    a = means[own[r]][r] / (sz - 1)
                    bb = min(means[u][r] / sizes[u] for u in uniq if u != own[r])
                    out[lo + r] = (bb - a) / max(a, bb) if max(a, bb) > 0 else 0.0
            yield pd.DataFrame({"s": out})

    vals = s.repartition(partitions, key).mapInPandas(score, "s double")
    return vals.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_squared(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Silhouette under squared Euclidean distance over ALL rows (N2), in two aggregations and no pairs.

    The sum of squared distances from a row to a cluster needs the cluster's count, vector sum and sum of squared norms only.
    The clusters' statistics (one row a cluster) meet the rows in an ordinary join on nothing but their single collected
    array, so their number bounds it. A singleton cluster's row scores 0, and so does everything under one cluster.
    """
    rows = df.na.drop(subset=list(cols))
    norm = sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0]))
    stats = rows.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in cols]).alias("s"), F.sum(norm).alias("q"))
    known = stats.collect()  # one row a cluster
    if len(known) < 2:
        return rows.agg(F.lit(0.0).alias("silhouette"), F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(r.l).alias("l"), F.lit(r.n).alias("n"), F.array(*[F.lit(float(v)) for v in r.s]).alias("s"), F.lit(float(r.q)).alias("q")) for r in known])
    cross = lambda c: F.aggregate(F.zip_with(F.array(*[F.col(x).cast("double") for x in cols]), c["s"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    total = lambda c: F.greatest(c["n"] * norm - 2 * cross(c) + c["q"], F.lit(0.0))
    own = F.filter(table, lambda c: c["l"] == F.col(label))
    a = F.transform(own, lambda c: F.when(c["n"] > 1, total(c) / (c["n"] - 1)))
    b = F.array_min(F.transform(F.filter(table, lambda c: c["l"] != F.col(label)), lambda c: total(c) / c["n"]))
    # names that no column has: inside a lambda a column of the rows would be taken for the new one beside it
    each = rows.select(F.get(a, F.lit(0)).alias("_inside_"), b.alias("_outside_"))
    inside, outside = F.col("_inside_"), F.col("_outside_")
    score = F.when(inside.isNull() | (F.greatest(inside, outside) == 0), 0.0).otherwise((outside - inside) / F.greatest(inside, outside))
    return each.agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n"))
