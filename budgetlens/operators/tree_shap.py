"""Additive attributions of histogram trees (M3, M4, M7), polynomial in depth.

For a leaf of value v whose path tests d columns, with o_j = 1 if the row passes all tests of column j and z_j the share of the
cover that does, the path-dependent Shapley value of column i is v (o_i - z_i) times the sum over subsets S of the other columns of
|S|! (d-|S|-1)! / d! times the o_j in S and the z_j outside it. That sum is the integral over t in (0, 1) of prod (o_j t + z_j (1 - t)), a
polynomial of degree d - 1, so Gauss-Legendre quadrature with ceil(d / 2) nodes is exact. No factor is zero (z_j > 0, t < 1), so the products
without one or two columns are quotients: O(d^2) work a leaf for values, O(d^3) for interactions, instead of 2^d.

Covers are sums of Hessians. A model is a bounded object (trees x nodes) and is broadcast once; rows are taken in blocks of ROWS, and of rows that
pass the same tests of a tree one is worked out for all (SAME_ROWS at a time).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Ensemble, Tree, column

ROWS = 256
SAME_ROWS = 2048  # rows among which those that pass the same tests of a tree are looked for
SAME_CELLS = 1 << 22  # numbers of an interaction array of such rows
TESTS = 62  # of a tree, whose outcomes are one number


@dataclass(frozen=True)
class PathTable:
    """The leaves of a tree that tests any column: (leaf, slot) -> column, bins (low, high] that pass, share of the cover."""
    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @cached_property
    def tests(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (column, bin) that rows are compared with."""
        both = [self.column[on] * 256 + at[on].astype(np.int64) for on, at in ((self.low >= 0, self.low), (self.high < 255, self.high))]
        found = np.unique(np.concatenate(both))
        return found >> 8, found & 255

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The columns tested, and what adds up (slot, leaf) by them."""
        return _grouped(self.column.T.ravel())

    @cached_property
    def pairs(self) -> tuple[list, np.ndarray, np.ndarray]:
        """Pairs of slots, the column pairs (first * 2^20 + second), and what adds up (pair of slots, leaf) by them."""
        pairs = list(combinations(range(self.column.shape[1]), 2))
        both = [self.column[:, [i, j]] for i, j in pairs]
        return pairs, *_grouped(np.concatenate([np.zeros(0, np.int64), *((x.min(axis=1) << 20) + x.max(axis=1) for x in both)]))


def _grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, of = np.unique(names, return_inverse=True)
    return used, (of[:, None] == np.arange(len(used))).astype(float)


def path_table(tree: Tree, values: np.ndarray) -> PathTable:
    leaves, stack = [], [(0, {})]
    while stack:
        v, path = stack.pop()
        if tree.feature[v] < 0:
            leaves.append((float(values[v]), path))
            continue
        f, whole = tree.feature[v], tree.sums[v][1]
        for kid, left in ((tree.left[v], True), (tree.right[v], False)):
            low, high, z = path.get(f, (-1, 255, 1.0))
            low, high = (low, min(high, tree.cut[v])) if left else (max(low, tree.cut[v]), high)
            stack.append((kid, {**path, f: (low, high, z * tree.sums[kid][1] / whole)}))
    width = max([len(p) for _, p in leaves], default=0)
    cells = np.array([[(f, *path[f]) for f in sorted(path)] + [(0, -1, 255, 1.0)] * (width - len(path)) for _, path in leaves], float).reshape(len(leaves), width, 4)
    return PathTable(cells[..., 0].astype(np.int64), cells[..., 1], cells[..., 2], cells[..., 3], np.array([v for v, _ in leaves]))


def path_tables(model: Ensemble) -> list[PathTable]:
    return [path_table(t, t.values(model.spec)) for t in model.trees]


def bias(model: Ensemble, tables: Sequence[PathTable]) -> float:
    """Cover-weighted mean of the model's margin."""
    return model.base + sum(float((t.value * t.cover.prod(axis=1)).sum()) for t in tables)


def _nodes(d: int) -> list[tuple[float, float]]:
    x, w = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
    return list(zip(((x + 1) / 2).tolist(), (w / 2).tolist(), strict=True))


def _parts(codes: np.ndarray, t: PathTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """At each quadrature node the weighted product of all factors times the leaf's value (row, leaf), and (o - z) / factor by slot (slot, row, leaf)."""
    x, cover = codes[:, t.column.T].transpose(1, 0, 2), t.cover.T[:, None, :]
    step = ((x > t.low.T[:, None, :]) & (x <= t.high.T[:, None, :])) - cover
    out = []
    for at, weight in _nodes(len(step)):
        factor = cover + step * at
        product = weight * t.value * factor[0]
        for f in factor[1:]:
            product *= f
        out.append((product, np.divide(step, factor, out=factor)))
    return out


def _distinct(codes: np.ndarray, t: PathTable) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows with all outcomes of the tree's tests, each outcome once if that halves them, and the place of every row's outcome (None: its own)."""
    columns, cuts = t.tests
    if len(columns) > TESTS:
        return codes, None
    key = np.zeros(len(codes), np.int64)
    for k, (c, cut) in enumerate(zip(columns.tolist(), cuts.tolist(), strict=True)):
        key |= (codes[:, c] > cut).astype(np.int64) << k
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return (codes[first], of) if 2 * len(first) <= len(codes) else (codes, None)


def _added(out: np.ndarray, columns: np.ndarray, values: list[np.ndarray], of: np.ndarray | None) -> None:
    """Add values, given in blocks of rows, to some columns of ``out``."""
    found = np.concatenate(values)
    out[:, columns] += found if of is None else found[of]


def _flat(by_slot: np.ndarray) -> np.ndarray:
    """(slot, row, leaf) -> (row, slot and leaf)."""
    return by_slot.transpose(1, 0, 2).reshape(by_slot.shape[1], -1)


def _values(parts: list) -> np.ndarray:
    out = sum(product * ratio for product, ratio in parts[1:]) if len(parts) > 1 else 0.0
    return _flat(parts[0][0] * parts[0][1] + out)


def _pair_values(parts: list, pairs: list) -> np.ndarray:
    out = np.zeros((len(pairs), *parts[0][0].shape))
    for product, ratio in parts:
        at = 0
        for i in range(len(ratio) - 1):  # ``pairs`` go by their first slot
            many = len(ratio) - 1 - i
            out[at : at + many] += (product * ratio[i]) * ratio[i + 1 :]
            at += many
    return _flat(out)


def shap_values(codes: np.ndarray, tables: Sequence[PathTable], p: int) -> np.ndarray:
    """rows x columns attributions on the margin's scale."""
    phi = np.zeros((len(codes), p))
    for a in range(0, len(codes), SAME_ROWS):
        codes_here, phi_here = np.asfortranarray(codes[a : a + SAME_ROWS]), phi[a : a + SAME_ROWS]
        for t in tables:
            if not t.column.size:
                continue
            (some, of), (used, to) = _distinct(codes_here, t), t.slots
            _added(phi_here, used, [_values(_parts(some[k : k + ROWS], t)) @ to for k in range(0, len(some), ROWS)], of)
    return phi


def interaction_values(codes: np.ndarray, tables: Sequence[PathTable], p: int) -> np.ndarray:
    """rows x columns x columns: main effects on the diagonal, half of each pair's effect on both sides; a row of it adds up to the attribution."""
    out, phi = np.zeros((len(codes), p * p)), np.zeros((len(codes), p))
    for a in range(0, len(codes), SAME_ROWS):
        codes_here, out_here, phi_here = np.asfortranarray(codes[a : a + SAME_ROWS]), out[a : a + SAME_ROWS], phi[a : a + SAME_ROWS]
        for t in tables:
            if not t.column.size:
                continue
            some, of = _distinct(codes_here, t)
            (used, to), (pairs, names, by) = t.slots, t.pairs
            single, double = [], []
            for k in range(0, len(some), ROWS):
                parts = _parts(some[k : k + ROWS], t)
                single.append(_values(parts) @ to)
                if pairs:
                    double.append(0.5 * (_pair_values(parts, pairs) @ by))
            _added(phi_here, used, single, of)
            if pairs:
                _added(out_here, (names >> 20) * p + (names & (1 << 20) - 1), double, of)
    half = out.reshape(-1, p, p)
    half[:, np.arange(p), np.arange(p)] = 0.0  # empty slots name the first column twice and add nothing
    whole = half + half.transpose(0, 2, 1)
    whole[:, np.arange(p), np.arange(p)] = phi - whole.sum(axis=2)
    return whole


def _rows(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    return df.select(key, F.array(*[F.coalesce(column(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("x"))


def _batches(batches: Iterator[pd.DataFrame], shared, p: int):
    model, tables = shared.value
    for b in batches:
        yield b, model.bins.codes(np.vstack(b["x"].to_numpy()).astype(float) if len(b) else np.zeros((0, p))), tables


def attributions(df: DataFrame, model: Ensemble, columns: Sequence[str], key: str) -> DataFrame:
    """Long ``(key, feature, phi)`` for every row and column, zeros included (M3)."""
    shared, p, names = df.sparkSession.sparkContext.broadcast((model, path_tables(model))), len(columns), np.array(list(columns), dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, codes, tables in _batches(batches, shared, p):
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), p), "feature": np.tile(names, len(b)), "phi": shap_values(codes, tables, p).ravel()})
    return _rows(df, columns, key).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, feature string, phi double")


def interaction_totals(df: DataFrame, model: Ensemble, columns: Sequence[str], key: str) -> DataFrame:
    """``(f1, f2, value)``: absolute main effects (f1 = f2) and pair effects (f1 < f2) added up over rows; a batch sends one row a pair."""
    shared, p, names = df.sparkSession.sparkContext.broadcast((model, path_tables(model))), len(columns), list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, codes, tables in _batches(batches, shared, p):
            total, step = np.zeros((p, p)), max(ROWS, min(SAME_ROWS, SAME_CELLS // max(1, p * p)))
            for a in range(0, len(codes), step):
                total += np.abs(interaction_values(codes[a : a + step], tables, p)).sum(axis=0)
            used = [(i, j) for i, j in zip(*np.nonzero(np.triu(total)), strict=True)]
            yield pd.DataFrame([(*sorted((names[i], names[j])), float(total[i, j])) for i, j in used], columns=["f1", "f2", "value"])
    return _rows(df, columns, key).mapInPandas(run, "f1 string, f2 string, value double")


def margins(df: DataFrame, model: Ensemble, columns: Sequence[str], key: str) -> DataFrame:
    """(key, margin, p) of every row."""
    shared, p = df.sparkSession.sparkContext.broadcast((model, None)), len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, codes, _ in _batches(batches, shared, p):
            yield pd.DataFrame({key: b[key], "margin": shared.value[0].margin(codes), "p": shared.value[0].probability(codes)})
    return _rows(df, columns, key).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, margin double, p double")


def additivity_error(phi: DataFrame, scored: DataFrame, base: float, key: str) -> DataFrame:
    """max |sum(phi) + bias - margin| (M4)."""
    total = phi.groupBy(key).agg(F.sum("phi").alias("_s"))
    return scored.join(total, key, "left").agg(
        F.max(F.abs(F.coalesce("_s", F.lit(0.0)) + F.lit(base) - F.col("margin"))).alias("max_abs_error"), F.count(F.lit(1)).alias("n"))
