"""Column roles and the leakage guard."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rate_if


@dataclass(frozen=True)
class ColumnRoles:
    identifier: tuple[str, ...] = ()
    weight: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    validation: tuple[str, ...] = ()
    leakage: tuple[str, ...] = ()

    def role_of(self, c: str) -> str:
        for role in ("identifier", "weight", "target", "validation", "leakage"):
            if c in getattr(self, role):
                return role
        return "feature"

    def features(self, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if self.role_of(c) == "feature"]

    def assert_safe(self, features: Sequence[str]) -> None:
        """Refuse a feature list that touches a leakage, target or validation column (H7)."""
        bad = sorted(c for c in features if self.role_of(c) in ("leakage", "target", "validation", "identifier"))
        if bad:
            raise ValueError(f"feature list uses excluded columns: {bad}")


def unit_roles(parts: Sequence[str]) -> ColumnRoles:
    return ColumnRoles(
        identifier=("unit_id",), weight=("weight",), target=("target",), validation=("has_flag",),
        leakage=(*parts, "total", "residual", "rate"),
    )


def select_by(df: DataFrame, prefix: str = "", suffix: str = "", exclude: Sequence[str] = ()) -> list[str]:
    """Column names by prefix/suffix minus an exclusion set."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c not in set(exclude)]


def catalogue(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Per column: role, dtype and null / zero / distinct counts from ONE aggregation."""
    cols = df.columns
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nul__{c}"), F.count_distinct(F.col(c)).alias(f"dst__{c}")]
        aggs.append((F.count_if(F.col(c) == 0) if c in numeric else F.lit(0).cast("long")).alias(f"zer__{c}"))
    row = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arr = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(roles.role_of(c)).alias("role"), F.lit(types[c]).alias("dtype"),
                 F.col(f"nul__{c}").alias("n_null"), F.col(f"zer__{c}").alias("n_zero"), F.col(f"dst__{c}").alias("n_distinct"))
        for c in cols])
    return row.select(F.inline(arr))


def leakage_scan(df: DataFrame, candidates: dict[str, Column], y: str) -> DataFrame:
    """Agreement of each candidate reconstruction of the target with the target (H7)."""
    row = df.agg(*[rate_if(expr.cast("int") == F.col(y)).alias(f"a{i}") for i, expr in enumerate(candidates.values())])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("candidate"), F.col(f"a{i}").alias("agreement")) for i, name in enumerate(candidates)])))

