"""Hand-off tables between phases, written once as Parquet in the shared checkpoint folder.

The study hands its unit table and feature table from step to step as files;
here they are Spark-written Parquet under ``spark.checkpoint.dir`` keyed by the
input files, which also cuts the lineage of every query that reads them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from .. import constants
from ..session import checkpoint_dir
from ..sources.standin import raw_units
from ..operators.ingest import build_units
from ..spec import STANDIN_SPEC

_INPUTS = ("customer", "orders", "lineitem", "part", "nation", "region")


def _hadoop(spark: SparkSession, path: str):
    """Hadoop file system and path object, so local folders, HDFS and object stores are all read alike."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, sf_dir: str, *settings) -> str:
    """Hash of the settings and of the length and time of every file of the input tables."""
    h = hashlib.sha1(repr(settings).encode())
    for t in _INPUTS:
        fs, p = _hadoop(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")
        h.update(fs.makeQualified(p).toString().encode())
        if not fs.exists(p):
            continue
        entries = fs.listStatus(p)
        for line in sorted(f"{e.getPath()} {e.getLen()} {e.getModificationTime()}" for e in entries):
            h.update(line.encode())
    return h.hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p))


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Read ``name`` for ``sf_dir`` if a complete copy of this input and these settings exists, else build, write, read."""
    key = fingerprint(spark, sf_dir, STANDIN_SPEC, constants.TARGET_THRESHOLD, constants.ZERO_INFLATED_RATE, constants.CORE_RATE, constants.WINSOR_Q)
    path = f"{checkpoint_dir(spark).rstrip('/')}/budgetlens/{name}_{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "raw", lambda: raw_units(spark, sf_dir))


def units_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit table (one row per unit, see FIXTURES.md section 6)."""
    return materialized(
        spark, sf_dir, "units", lambda: build_units(raw_table(spark, sf_dir), STANDIN_SPEC)
    )


def build_features(units):
    """The feature table: Unknown levels, participation flags, winsorised debt, CLR of core parts.

    Returns ``(features_df, info)`` where ``info`` holds the fitted lists and scalars.
    """
    from pyspark.sql import functions as F

    from ..operators import features as FE
    from ..operators import simplex as SX
    from ..spec import CATEGORICALS, SHARES

    zs = SX.fit_zero_sets(units, SHARES)
    wf = FE.fit_winsor(units, "debt_to_income")
    zr = SX.fit_zero_replacement(units, zs.core)
    core_names = [c.removesuffix("_share") for c in zs.core]
    zr_cols = SX.zero_replaced(zs.core, zr)
    staged = units.select("*", *zr_cols)
    clr_cols = SX.clr([f"{c}_zr" for c in zs.core], [f"{n}_clr" for n in core_names])
    feats = staged.select(
        "unit_id", "weight", "income", *SHARES, "log_income", "size", "dependents",
        *SX.participation_flags(zs.zero_inflated),
        FE.winsorized("debt_to_income", wf, "debt_to_income_w"),
        (F.col("debt_to_income") > 0).cast("int").alias("has_debt"),
        F.try_divide(F.col("dependents"), F.col("size")).alias("dependency_ratio"),
        *FE.fill_unknown(CATEGORICALS),
        *clr_cols,
        "has_flag", "target", "rate",
    )
    info = {"zero_sets": zs, "winsor": wf, "zero_replacement": zr}
    return feats, info


def features_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "features", lambda: build_features(units_table(spark, sf_dir))[0])
