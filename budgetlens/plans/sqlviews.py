"""DuckDB SQL for the stand-in unit table, shared as a CTE prefix by every oracle.

The oracle is an independent statement of the same definitions, written the
way an analyst would in SQL; it is only used to check the Spark plans.
"""

from __future__ import annotations

from ..constants import TARGET_THRESHOLD
from ..sources.standin import FLAG_ORDER_VALUE, MONTHLY_ITEMS, N_ITEMS, SEGMENT_NULL_ABOVE
from ..spec import STANDIN_SPEC, RollupSpec


def D(x: float) -> str:
    """A DOUBLE literal (plain decimals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def nz(cols) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in cols) if cols else "0"


def _raw_ctes(spec: RollupSpec = STANDIN_SPEC) -> str:
    items = ",\n    ".join(
        f"sum(CASE WHEN item = {k} THEN amount END){' / 12' if k <= MONTHLY_ITEMS else ''} AS item_{k}"
        for k in range(1, N_ITEMS + 1)
    )
    pri = ",\n    ".join(
        f"count(*) FILTER (WHERE o_orderpriority = '{lab}') AS {c}" for c, lab in spec.count_labels
    )
    pri_sel = ", ".join(f"coalesce(o.{c}, 0) AS {c}" for c, _ in spec.count_labels)
    item_sel = ", ".join(f"i.item_{k}" for k in range(1, N_ITEMS + 1))
    return f"""li AS (
  SELECT o.o_custkey AS unit_id, p.p_size AS item, l.l_extendedprice * (1 - l.l_discount) AS amount
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
),
items AS (
  SELECT unit_id,
    {items}
  FROM li GROUP BY unit_id
),
ords AS (
  SELECT o_custkey AS unit_id, sum(o_totalprice) AS income, count(*) AS size,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS dependents,
    {pri},
    max(CASE WHEN o_totalprice > {D(FLAG_ORDER_VALUE)} THEN 1 ELSE 0 END) AS has_flag
  FROM orders GROUP BY o_custkey
),
raw AS (
  SELECT c.c_custkey AS unit_id, 1 + c.c_nationkey / {D(25.0)} AS weight, o.income,
    coalesce(o.size, 0) AS size, coalesce(o.dependents, 0) AS dependents, {pri_sel},
    r.r_name AS area,
    CASE WHEN c.c_acctbal > {D(SEGMENT_NULL_ABOVE)} THEN NULL ELSE c.c_mktsegment END AS segment,
    greatest(-c.c_acctbal, {D(0)}) AS debt, coalesce(o.has_flag, 0) AS has_flag, {item_sel}
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN ords o ON c.c_custkey = o.unit_id
  LEFT JOIN items i ON c.c_custkey = i.unit_id
)"""


def _part_sql(monthly, annual, months: int) -> str:
    expr = D(0)
    if monthly:
        expr += f" + ({nz(monthly)}) * {months}"
    if annual:
        expr += f" + ({nz(annual)})"
    return expr


def units_ctes(spec: RollupSpec = STANDIN_SPEC, threshold: float = TARGET_THRESHOLD) -> str:
    """``WITH``-less list of CTEs ending in ``units`` (and ``raw``, ``rolled``)."""
    parts = spec.part_names
    part_exprs = ",\n    ".join(
        f"{_part_sql(m, a, spec.months_per_year)} AS {p}" for p, (m, a) in spec.parts.items()
    )
    counts = [c for c, _ in spec.count_labels]
    mx = f"greatest({', '.join(counts)})"
    occ = " ".join(f"WHEN {c} = {mx} THEN '{lab}'" for c, lab in spec.count_labels)
    shares = ", ".join(f"{p} / nullif(total, 0) AS {p}_share" for p in parts)
    return f"""{_raw_ctes(spec)},
rolled0 AS (
  SELECT *,
    {part_exprs}
  FROM raw
),
rolled AS (SELECT *, {nz(parts)} AS total FROM rolled0),
units AS (
  SELECT unit_id, CAST(weight AS DOUBLE) AS weight, CAST(income AS DOUBLE) AS income, ln(income) AS log_income,
    CAST(size AS BIGINT) AS size, CAST(dependents AS BIGINT) AS dependents,
    CASE WHEN {mx} = 0 THEN '{spec.default_label}' {occ} END AS occupation,
    area, segment, coalesce(debt, 0) / income AS debt_to_income,
    {shares},
    CAST(has_flag AS INTEGER) AS has_flag, {", ".join(parts)}, total,
    income - total AS residual, (income - total) / income AS rate,
    CAST(CASE WHEN (income - total) / income >= {D(threshold)} THEN 1 ELSE 0 END AS INTEGER) AS target
  FROM rolled
  WHERE income > 0 AND total IS NOT NULL AND total > 0
)"""


def with_units(body: str, extra: str = "") -> str:
    """``WITH <units ctes>[, extra] <body>``."""
    ctes = units_ctes()
    if extra:
        ctes += ",\n" + extra.strip().rstrip(",")
    return f"WITH {ctes}\n{body}"
