"""Description of a unit table: which raw items roll up into which parts.

A ``RollupSpec`` is pure metadata; operators take it instead of hard-coding
column names, so the same code runs on any "unit x additive items" table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RollupSpec:
    # part name -> (monthly item columns, annual item columns)
    parts: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]
    # count columns for the arg-max label, in tie-break order, with their labels
    count_labels: tuple[tuple[str, str], ...] = ()
    default_label: str = "none"
    months_per_year: int = 12

    @property
    def part_names(self) -> list[str]:
        return list(self.parts)

    @property
    def share_names(self) -> list[str]:
        return [f"{p}_share" for p in self.parts]

    @property
    def item_columns(self) -> list[str]:
        seen: list[str] = []
        for monthly, annual in self.parts.values():
            for c in (*monthly, *annual):
                if c not in seen:
                    seen.append(c)
        return seen


def _items(lo: int, hi: int) -> tuple[str, ...]:
    return tuple(f"item_{k}" for k in range(lo, hi + 1))


# Stand-in built from the TPC-H-like test tables: item k = spend on parts of size k.
# Items 1-33 are monthly amounts, 34-50 annual ones.
# fixed values: item ranges per part, and the priority labels in tie-break order
STANDIN_SPEC = RollupSpec(
    parts={
        "groceries": (_items(1, 14), ()),
        "eating_out": ((), ("item_45",)),
        "utilities": (_items(15, 19), ()),
        "rent": ((), ("item_49",)),
        "transport": (_items(20, 22), ()),
        "healthcare": (_items(23, 25), ()),
        "education": ((), ("item_46",)),
        "entertainment": ((), ("item_47",)),
        "insurance": ((), ("item_48",)),
        "clothing": (_items(26, 29), ()),
        "misc": (_items(30, 33), _items(34, 44) + ("item_50",)),
    },
    count_labels=(
        ("pri_1", "1-URGENT"),
        ("pri_2", "2-HIGH"),
        ("pri_3", "3-MEDIUM"),
        ("pri_4", "4-NOT SPECIFIED"),
        ("pri_5", "5-LOW"),
    ),
    default_label="none",
)

PARTS = STANDIN_SPEC.part_names
SHARES = STANDIN_SPEC.share_names
CATEGORICALS = ["occupation", "area", "segment"]
