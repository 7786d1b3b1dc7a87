"""Ingest: delimited scan with a column contract, coercion, roll-up, unit build."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import TARGET_THRESHOLD
from ..functions.columns import argmax_label, flag, nz_sum, safe_div, to_double
from ..spec import RollupSpec

UNIT_ID = "unit_id"


def require_columns(columns: Iterable[str], keep: Iterable[str]) -> None:
    """Column contract of a scan: raise with the sorted missing names (A2)."""
    missing = set(keep) - set(columns)
    if missing:
        raise KeyError(f"input is missing expected columns: {sorted(missing)}")


def scan_delimited(spark: SparkSession, path: str, keep: Sequence[str], sep: str = "\t") -> DataFrame:
    """Read a delimited file as text, keep only ``keep`` and coerce each to DOUBLE (A1-A3).

    The header is read once to check the contract before any job runs; the
    schema is all-string so no inference pass is made, and the projection
    prunes the columns the reader materialises.
    """
    header = spark.read.option("sep", sep).option("header", True).csv(path).columns
    require_columns(header, keep)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)
    return df.select(*[to_double(F.col(c)).alias(c) for c in keep])


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Lossy numeric coercion of text columns: bad text and NaN -> NULL (A3)."""
    cols = list(cols or df.columns)
    return df.select(*[to_double(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def rollup_parts(spec: RollupSpec) -> list:
    """Per part: ``12 * sum(monthly) + sum(annual)`` with NULL items as zero."""
    out = []
    for name, (monthly, annual) in spec.parts.items():
        expr = F.lit(0.0)
        if monthly:
            expr = expr + nz_sum(monthly) * spec.months_per_year
        if annual:
            expr = expr + nz_sum(annual)
        out.append(expr.alias(name))
    return out


def with_parts(df: DataFrame, spec: RollupSpec) -> DataFrame:
    """Append the rolled-up part columns and their total (one projection, no shuffle)."""
    df = df.select("*", *rollup_parts(spec))
    return df.withColumn("total", nz_sum(spec.part_names))


def computable(df: DataFrame, income: str = "income", total: str = "total") -> DataFrame:
    """Keep rows whose residual rate is defined: income > 0 and total > 0."""
    return df.filter((F.col(income) > 0) & F.col(total).isNotNull() & (F.col(total) > 0))


def target_columns(threshold: float = TARGET_THRESHOLD, income: str = "income", total: str = "total") -> dict:
    """Residual, residual rate and the thresholded target."""
    residual = F.col(income) - F.col(total)
    rate = safe_div(residual, F.col(income))
    return {
        "residual": residual,
        "rate": rate,
        "target": flag(rate >= F.lit(float(threshold))),
    }


def build_units(raw: DataFrame, spec: RollupSpec, threshold: float = TARGET_THRESHOLD) -> DataFrame:
    """Raw wide table -> unit table: roll-up, filter, target, shares, labels, ratios.

    One lazy plan of projections and a filter; the filter sits above the scan so
    Catalyst pushes ``income > 0`` into the Parquet reader when income is stored.
    """
    parts = spec.part_names
    counts = [c for c, _ in spec.count_labels]
    labels = [lab for _, lab in spec.count_labels]
    df = computable(with_parts(raw, spec))
    tc = target_columns(threshold)
    return df.select(
        F.col(UNIT_ID),
        F.col("weight").cast("double").alias("weight"),
        F.col("income").cast("double").alias("income"),
        F.ln(F.col("income")).alias("log_income"),
        F.col("size").cast("bigint").alias("size"),
        F.col("dependents").cast("bigint").alias("dependents"),
        argmax_label(counts, labels, spec.default_label).alias("occupation"),
        F.col("area"),
        F.col("segment"),
        safe_div(F.coalesce(F.col("debt"), F.lit(0.0)), F.col("income")).alias("debt_to_income"),
        *[safe_div(F.col(p), F.col("total")).alias(f"{p}_share") for p in parts],
        F.col("has_flag").cast("int").alias("has_flag"),
        *[F.col(p) for p in parts],
        F.col("total"),
        tc["residual"].alias("residual"),
        tc["rate"].alias("rate"),
        tc["target"].alias("target"),
    )


def build_counters(raw: DataFrame, spec: RollupSpec, threshold: float = TARGET_THRESHOLD) -> DataFrame:
    """Raw, dropped and kept counts and the target rate in one scan."""
    df = with_parts(raw, spec)
    keep = F.coalesce((F.col("income") > 0) & (F.col("total") > 0), F.lit(False))
    rate = safe_div(F.col("income") - F.col("total"), F.col("income"))
    hit = F.when(keep, flag(rate >= F.lit(float(threshold))).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(~keep).alias("n_dropped"),
        F.count_if(keep).alias("n_kept"),
        F.avg(hit).alias("target_rate"),
    )
