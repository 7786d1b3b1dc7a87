"""Evaluation metrics as aggregations over ``(y, score, pred)``.

Ranking metrics never sort the raw rows: they aggregate to one row per distinct
score first (a hot score value becomes one row) and take exact prefix sums over
that distinct set with ``functions.ranking.prefix_sums``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, flag
from ..functions.ranking import prefix_sums
from .binning import equal_width_bin, linspace


def confusion(df: DataFrame, y: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp (by group) in one aggregation (K1)."""
    yy, pp = F.col(y), F.col(pred)
    return df.groupBy(*group).agg(
        count_if((yy == 0) & (pp == 0)).alias("tn"), count_if((yy == 0) & (pp == 1)).alias("fp"),
        count_if((yy == 1) & (pp == 0)).alias("fn"), count_if((yy == 1) & (pp == 1)).alias("tp"),
    )


def _safe(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(df: DataFrame, y: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall (positive class, 0/0 -> 0) and macro-F1, by group (K2, K3)."""
    c = confusion(df, y, pred, group)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = _safe(tp, tp + fp), _safe(tp, tp + fn)
    p0, r0 = _safe(tn, tn + fn), _safe(tn, tn + fp)
    f1 = _safe(2 * p1 * r1, p1 + r1)
    f0 = _safe(2 * p0 * r0, p0 + r0)
    return c.select(
        *group, ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"), p1.alias("precision"), r1.alias("recall"),
        ((f0 + f1) / 2).alias("f1_macro"),
    )


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class precision, recall, F1, support, plus macro and weighted averages (K4)."""
    c = confusion(df, y, pred)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p1, r1, p0, r0 = _safe(tp, tp + fp), _safe(tp, tp + fn), _safe(tn, tn + fn), _safe(tn, tn + fp)
    f1, f0 = _safe(2 * p1 * r1, p1 + r1), _safe(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))

    return c.select(F.inline(F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n),
    )))


def score_counts(df: DataFrame, y: str, score: str, part_cols: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: positives and negatives (the only shuffle of a ranking metric)."""
    return df.filter(F.col(score).isNotNull()).groupBy(*part_cols, score).agg(
        count_if(F.col(y) == 1).alias("pos"), count_if(F.col(y) == 0).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, part_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted half (Mann-Whitney), per partition (K5)."""
    sc = score_counts(df, y, score, part_cols)
    pre = prefix_sums(sc, [score], ["neg"], part_cols)
    below = F.col("cum_neg") - F.col("neg")
    return pre.groupBy(*part_cols).agg(
        (F.sum(F.col("pos") * (below + F.col("neg") * 0.5)) /
         (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("roc_auc"))


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """Precision-recall points per distinct threshold, up to the first full recall, plus (1, 0) (K6).

    Returned with an ``idx`` that orders points as the reference's arrays (increasing threshold,
    the (precision 1, recall 0) point last).
    """
    sc = score_counts(df, y, score)
    pre = prefix_sums(sc, [score], ["pos", "neg"], descending=True)
    total_pos = sc.agg(F.sum("pos")).first()[0] or 0  # one scalar, folded in as a literal
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    j = pre.withColumn("_positives_", F.lit(int(total_pos)))  # names don't differ by case: a score may be called p
    # keep thresholds down to the first one that reaches full recall
    kept = j.filter((F.col("cum_pos") - F.col("pos") < F.col("_positives_")) | (F.col("_positives_") == 0))
    curve = kept.select(
        F.col(score).alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / F.col("_positives_")).alias("recall"))
    end = sc.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                             F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def best_f1(curve: DataFrame) -> DataFrame:
    """Point maximising F1 (with the 1e-12 guard); first in increasing-threshold order on ties (K7)."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12)
    c = curve.filter(F.col("threshold").isNotNull()).withColumn("f1", f1)
    return c.agg(F.min_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")).select("b.*")


def operating_points(curve: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Point with recall nearest each target; first in increasing-threshold order on ties (K8)."""
    thr_order = F.coalesce(F.col("threshold"), F.lit(float("inf")))
    point = F.struct("threshold", "precision", "recall")
    best = [F.min_by(point, F.struct(F.abs(F.col("recall") - F.lit(float(t))), thr_order)).alias(f"b{i}") for i, t in enumerate(targets)]
    row = [F.struct(F.lit(float(t)).alias("target_recall"), *[F.col(f"b{i}.{c}").alias(c) for c in ("threshold", "precision", "recall")]) for i, t in enumerate(targets)]
    return curve.agg(*best).select(F.inline(F.array(*row)))


def fold_summary(df: DataFrame, metrics: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd over folds (K9)."""
    return df.groupBy(*group).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics],
                                  *[F.stddev_pop(m).alias(f"{m}_sd") for m in metrics])


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean predicted vs observed per equal-width bin (right-closed), empty bins absent."""
    edges = linspace(0.0, 1.0, bins + 1)
    g = df.select(equal_width_bin(p, edges).alias("bin"), F.col(p), F.col(y)).filter(F.col("bin").isNotNull())
    out = g.groupBy("bin").agg(F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual"),
                               F.count(F.lit(1)).alias("n"))
    return out.withColumn("error", F.col("actual") - F.col("predicted"))


def accuracy_by_slice(df: DataFrame, p: str, y: str, slice_col: str, cut: float = 0.5) -> DataFrame:
    """Accuracy of ``p > cut`` and count per slice."""
    correct = flag((F.col(p) > F.lit(cut)).cast("int") == F.col(y))
    return df.filter(F.col(slice_col).isNotNull()).groupBy(slice_col).agg(
        F.avg(correct.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
