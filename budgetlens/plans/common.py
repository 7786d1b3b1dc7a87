"""Shared helpers for registered queries: output rounding on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import PARTS, SHARES

# money with at most 4 decimals; monthly items (amount / 12) are rounded to 6 places, where
# k / 120000 can never sit exactly on a rounding tie
MONEY = {"income", "total", "residual", *PARTS, "debt"} | {f"item_{k}" for k in range(34, 51)}


def rounded(df: DataFrame, money=(), d: int = 6, md: int = 4) -> DataFrame:
    """Round every DOUBLE column: ``md`` places for money, ``d`` for the rest.

    Sums are computed in a different order by each engine; rounding keeps the
    comparison to the digits that carry meaning.
    """
    money = set(money) | MONEY
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(F.col(f.name).cast("double"), md if f.name in money else d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rsql(body: str, r6: str = "", r2: str = "") -> str:
    """Wrap a SELECT so the named columns are rounded like :func:`rounded`."""
    r6 = r6.split() if isinstance(r6, str) else list(r6)
    r2 = r2.split() if isinstance(r2, str) else list(r2)
    reps = [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in r6]
    reps += [f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in r2]
    if not reps:
        return body
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{body}\n) q"


UNIT_DOUBLES6 = " ".join(["weight", "log_income", "debt_to_income", *SHARES, "rate"])
UNIT_DOUBLES2 = " ".join(["income", *PARTS, "total", "residual"])


def union_sql(items, template: str) -> str:
    """``template`` formatted once per item and joined with UNION ALL."""
    return "\nUNION ALL\n".join(template.format(c=c, i=i) for i, c in enumerate(items))


def lit_list(xs) -> str:
    return ", ".join(repr(x) if isinstance(x, str) else f"CAST({float(x)!r} AS DOUBLE)" for x in xs)
