"""Second-order histogram trees: boosting (L10, L11) and random forests (L9), many models in one pass over the rows.

A tree needs, for each open node, column and bin, the sums of the rows' gradients, Hessians and counts. The best split of a node
has the largest ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``; a leaf is worth ``-G/(H+l2)`` times the learning rate. A forest is
the same with gradient -y and Hessian 1 (the split is then the Gini one, a leaf the share of positives). Trees grow level by level or
best first, up to a number of leaves. A ``grower`` says which nodes' splits it wants next; where these come from is another matter:

* ``in_tasks``  : the rows' bins (two bytes each), if they number LOCAL_CELLS at most (counted first), reach every task once by broadcast, and
                  each task trains a whole model, or FOREST_PART trees of a forest. These are spread over the cluster; no job a level is needed.
* ``by_reading``: up to TASK_CELLS, bins are written once as a reliable checkpoint, and each task reads the training rows of its fold from it, a byte a
                  cell; nothing is broadcast and the driver sees no rows. It trains the models (or parts of forests) dealt to it one after another.
* ``over_rows`` : beyond that, rows stay where they are, in blocks. One scan answers all open nodes of all models at once: each task adds up the
                  bins of its rows (``mapInArrow``). If those of all tasks are DIRECT_BYTES at most, the driver adds them up; otherwise the cells of
                  one (model, node) meet in a shuffle, and only the best split of each comes back. The fold is part of a model's key, so a scan
                  advances all folds and draws. Margins are written every KEEP rounds.

Columns of few bins share a byte (``Layout``), large nodes are added up by several columns at once (``Joint``), of two siblings only the smaller is read where their parent's sums are known, and forests count
both classes in one whole number. Both use the same kernels, samples and bins, so they give the same trees. Rows, columns and bootstrap counts are drawn by hashes of
(row, tree, seed): the same at every run and partitioning.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 255
LOCAL_CELLS = 1 << 26  # rows x columns that a task may hold: 64 MB of bins
TASK_CELLS = 1 << 28  # the same where a task reads its own rows: 256 MB of bins
FOREST_PART = 15  # trees of a forest that a task trains
KEEP = 8  # rounds between written margins
DRAW_ROWS = 1 << 18  # rows whose draws are worked out at once
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class TreeSpec:
    """What the study's tree models vary. Kinds: ``boost``, ``forest``, ``tree``. ``leaves`` grows best first, ``node_columns`` draws columns for every node."""
    kind: str = "boost"
    rounds: int = 100
    rate: float = 0.1
    depth: int | None = None
    leaves: int | None = None
    l2: float = 0.0
    least_hessian: float = 1e-3
    least_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    node_columns: int | None = None
    balanced: bool = False
    seed: int = 42


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. Rows of bin ``cut`` and below go left."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    sums: list = field(default_factory=lambda: [(0.0, 0.0, 0)])  # gradient, Hessian (the cover) and rows

    def split(self, v: int, best: tuple) -> tuple[int, int]:
        _, feature, cut, g, h, n = best
        total = self.sums[v]
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[v], self.cut[v], self.left[v], self.right[v] = feature, cut, a, b
        for s in ((g, h, n), (total[0] - g, total[1] - h, total[2] - n)):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.sums.append(s)
        return a, b

    def routed(self, codes: np.ndarray) -> np.ndarray:
        """Node of each row."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        own, leaf = np.arange(len(feature)), feature < 0
        step = np.column_stack((np.where(leaf, own, left), np.where(leaf, own, right))).ravel()  # a leaf leads to itself
        depth, level = 0, own[:1]
        while len(level := level[~leaf[level]]):
            depth, level = depth + 1, np.concatenate((left[level], right[level]))
        node, flat = np.zeros(len(codes), np.int32), codes.T.reshape(-1)  # column by column
        for a in range(0, len(codes), BLOCK_ROWS):
            at, rows = node[a : a + BLOCK_ROWS], np.arange(a, min(a + BLOCK_ROWS, len(codes)))
            base = np.where(leaf, 0, feature) * len(codes)
            for _ in range(depth):
                at = step.take((at << 1) + (flat.take(base.take(at) + rows) > cut.take(at)))
            node[a : a + BLOCK_ROWS] = at
        return node

    def values(self, spec: TreeSpec) -> np.ndarray:
        s = np.array([(g, h) for g, h, _ in self.sums])
        out = -s[:, 0] / np.maximum(s[:, 1] + spec.l2, 1e-12)
        return out * spec.rate if spec.kind == "boost" else out


# --------------------------------------------------------------------------- draws
def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for every id, fixed by id and salt; an array of salts (uint64) is combined with the ids elementwise."""
    x = ids.astype(np.int64).view(np.uint64)
    for s in salt:
        step = s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019) if isinstance(s, np.ndarray) else np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = _mix(x + step)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def row_weights(ids: np.ndarray, spec: TreeSpec, tree: int) -> np.ndarray:
    """How often each row counts in a tree: a Poisson draw in forests (the bootstrap), once in a single tree, 0 or 1 in boosting."""
    if spec.kind == "tree":
        return np.ones(len(ids))
    if len(ids) > DRAW_ROWS:
        out = np.empty(len(ids))
        for a in range(0, len(ids), DRAW_ROWS):
            out[a : a + DRAW_ROWS] = row_weights(ids[a : a + DRAW_ROWS], spec, tree)
        return out
    if spec.kind == "forest":
        return np.searchsorted(_POISSON, uniform(ids, spec.seed, tree), side="right").astype(np.float64)
    return np.ones(len(ids)) if spec.row_share >= 1 else (uniform(ids, spec.seed, tree) < spec.row_share).astype(np.float64)


def tree_columns(p: int, spec: TreeSpec, tree: int) -> np.ndarray:
    if spec.column_share >= 1:
        return np.arange(p)
    return np.sort(np.argsort(uniform(np.arange(p), spec.seed + 1, tree), kind="stable")[: max(1, int(spec.column_share * p))])


def node_columns(columns: np.ndarray, spec: TreeSpec, tree: int, nodes: Sequence[int]) -> np.ndarray:
    """(node, slot) -> column."""
    if spec.node_columns is None or spec.node_columns >= len(columns):
        return np.broadcast_to(columns, (len(nodes), len(columns)))
    drawn = uniform(np.broadcast_to(columns, (len(nodes), len(columns))), spec.seed + 2, tree, np.asarray(nodes, np.uint64)[:, None])
    return columns[np.sort(np.argsort(drawn, axis=1, kind="stable")[:, : spec.node_columns], axis=1)]


# --------------------------------------------------------------------------- kernels
VOTE = float(1 << 26)  # a positive row's weight where both classes are counted in one number


def _decoded(sums: np.ndarray, votes: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian sums of a forest from counts of both classes in one number; ``votes``: the classes' weights, positive first."""
    positive = np.floor(sums / VOTE)
    negative = sums - positive * VOTE
    return -votes[0] * positive, votes[0] * positive + votes[1] * negative


def cells_of(codes: np.ndarray, slot_columns: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray | None, rows: np.ndarray | None = None) -> tuple:
    """Sums over rows (``rows`` of ``codes``, if not all) by cell, for the cells that have rows: (cell, gradient, Hessian, rows); cell = (node, slot, bin)."""
    q = slot_columns.shape[1]
    key = ((node[:, None] * q + np.arange(q)) << 8 | codes[(np.arange(len(codes)) if rows is None else rows)[:, None], slot_columns[node]]).ravel()
    width = len(slot_columns) * q << 8
    weights = [np.repeat(x, q) for x in (g, h) if x is not None]
    if width <= 8 * len(key):
        count = np.bincount(key, minlength=width)
        cell = np.flatnonzero(count)
        sums, n = [np.bincount(key, x, width)[cell] for x in weights], count[cell]
    else:
        cell, *sums, n = _summed(key, *weights)
    return cell, sums[0], sums[1] if h is not None else None, n


def _summed(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, sums.., count) of the keys at hand. Key and place are sorted as one number, which is much faster than an argsort."""
    if not len(key):
        return key, *weights, key
    bits = max(1, int(len(key) - 1).bit_length())
    if int(key.max()).bit_length() + bits < 63:
        both = np.sort(key << bits | np.arange(len(key)))
        key, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    begins = np.diff(key, prepend=key[0] - 1) != 0
    first, of = np.flatnonzero(begins), np.cumsum(begins) - 1
    return key[first], *(np.bincount(of, x[order], len(first)) for x in weights), np.diff(np.append(first, len(key)))


def counted(spec: TreeSpec) -> bool:
    """Whether splits need the rows of a bin: not if least_rows asks for one, as the Hessian of no rows is below least_hessian anyway."""
    return spec.kind != "boost" or spec.least_rows > 1 or spec.least_hessian < 1e-3


def _gains(gl: np.ndarray, hl: np.ndarray, nl: np.ndarray | None, gt: np.ndarray, ht: np.ndarray, nt: np.ndarray | None, spec: TreeSpec) -> np.ndarray:
    gr, hr = gt - gl, ht - hl
    fine = np.minimum(hl, hr) >= spec.least_hessian
    if nl is not None:
        least = max(1, spec.least_rows)  # a cut after a column's last bin leaves no rows
        fine &= np.minimum(nl, nt - nl) >= least
    with np.errstate(divide="ignore", invalid="ignore"):
        gain, hr = gl * gl, hr + spec.l2  # in place from here on: these arrays are large
        gain /= hl + spec.l2
        gr *= gr
        gr /= hr
        gain += gr
        gain -= gt * gt / (ht + spec.l2)
    gain[~fine] = 0.0
    return gain


NONE = (0.0, -1, 0, 0.0, 0.0, 0)


def best_splits(cell: np.ndarray, g: np.ndarray, h: np.ndarray | None, n: np.ndarray, slot_columns: np.ndarray, spec: TreeSpec, votes: tuple[float, float] | None = None) -> list[tuple]:
    """Per node: its sums (G, H, rows) and the best split (gain, column, bin, GL, HL, rows left); gain 0 if none. With ``votes``, ``g`` counts both classes."""
    nodes, q = slot_columns.shape
    if not len(cell):
        return [((0.0, 0.0, 0), NONE)] * nodes
    slot = cell >> 8
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    base = np.repeat(first, np.diff(np.append(first, len(cell))))
    given = [x for x in (g, h, n) if x is not None]
    *sums, nl = (c - (c - x)[base] for c, x in zip(map(np.cumsum, given), given, strict=True))
    gl, hl = sums if votes is None else _decoded(sums[0], votes)
    node = slot // q
    last = np.append(first[1:], len(cell)) - 1
    total = np.zeros((nodes, 3))
    some, at = np.unique(node[first], return_index=True)
    lead = last[at]  # every slot of a node has its sums
    total[some] = np.column_stack((gl[lead], hl[lead], nl[lead]))
    gain = _gains(gl, hl, nl, *(total[node, k] for k in range(3)), spec)
    gain[last] = 0.0
    top = np.zeros(nodes)
    top[some] = np.maximum.reduceat(gain, first[at])
    top[~(top > 1e-9 * np.maximum(1.0, np.abs(total[:, 0])))] = 0.0
    near = np.flatnonzero((gain >= top[node] * (1 - 1e-10)) & (top[node] > 0))  # ties to the first column and bin, also after another order of summing
    having, pick = np.unique(node[near], return_index=True)
    i = near[pick]
    out: list = [((a, b, int(c)), NONE) for a, b, c in total.tolist()]
    for v, *split in zip(having.tolist(), top[having].tolist(), slot_columns[having, slot[i] % q].tolist(), (cell[i] & 255).tolist(), gl[i].tolist(), hl[i].tolist(), nl[i].tolist(), strict=True):
        out[v] = (out[v][0], (*split[:5], int(split[5])))
    return out


DENSE_ROWS = 256  # rows a node from which all bins of a drawn column are written out
PACKED_ROWS = 64  # the same where the nodes share their columns
CHUNK_CELLS = 1 << 18  # of nodes that are worked out at once
BOOST_CELLS = 1 << 17  # the same where many rounds follow: their sums stay in a core's cache
DRAWN_CELLS = 1 << 15  # the same for nodes with columns of their own
DENSE_CELLS = 1 << 18  # cells of a model's open nodes that a task may write out: 6 MB
BLOCK_ROWS = 1 << 13  # rows whose slopes and keys stay in a core's cache
NARROW = 8
JOINT_CELLS = 1 << 16
JOINT_ROWS = 1 << 15  # rows of a node from which several arrays are added up at once


@dataclass(frozen=True)
class Layout:
    """How bins are added up: a wide column by itself, columns of few bins several to a byte (mixed radix)."""
    wide: list
    packs: list  # lists of (column, stride)
    spread: list  # a pack's 256 byte values -> (column, bin)

    @property
    def narrow(self) -> np.ndarray:
        return np.array([c for pack in self.packs for c, _ in pack], int)

    def arrays(self, codes: np.ndarray) -> list[np.ndarray]:
        return [codes[:, j] for j in self.wide] + [sum((codes[:, c] * np.uint8(stride) for c, stride in pack), np.zeros(len(codes), np.uint8)) for pack in self.packs]


def layout(width: np.ndarray) -> Layout:
    """``width``: bins of each column."""
    packs, size = [], 257
    for c in np.flatnonzero(width <= NARROW).tolist():
        if size * int(width[c]) > 256:
            packs, size = [*packs, []], 1
        packs[-1].append((c, size))
        size *= int(width[c])
    spread = []
    for pack in packs:
        to = np.zeros((256, len(pack), NARROW))
        for k, (c, stride) in enumerate(pack):
            to[np.arange(256), k, np.arange(256) // stride % int(width[c])] = 1.0
        spread.append(to.reshape(256, -1))
    return Layout(np.flatnonzero(width > NARROW).tolist(), packs, spread)


def bin_sums(arrays: Sequence[np.ndarray], rows: np.ndarray, at: np.ndarray, nodes: int, weights: Sequence[np.ndarray], votes: tuple[float, float] | None = None, out: np.ndarray | None = None, count: bool = True) -> np.ndarray:
    """Sums of gradients, Hessians and rows (if ``count``) as (sum, node, array, byte) for the nodes ``at`` (ascending) of ``rows``; added to ``out`` if given."""
    out = np.zeros((len(weights) + count, nodes, len(arrays), 256)) if out is None else out
    for a in range(0, len(rows), BLOCK_ROWS):
        r, v = rows[a : a + BLOCK_ROWS], at[a : a + BLOCK_ROWS]
        mine = [w[r] for w in weights]
        u, e = int(v[0]), int(v[-1]) + 1
        base, size = (v - u) << 8, (e - u) << 8
        for k, c in enumerate(arrays):
            key = c.take(r) + base
            for i, w in enumerate((*mine, None) if count else mine):
                out[i, u:e, k] += np.bincount(key, w, size).reshape(-1, 256)
    return out if votes is None else np.stack((*_decoded(out[0], votes), out[1]))


@dataclass(frozen=True)
class Joint:
    """Arrays of bytes, several to a number below JOINT_CELLS: large nodes are added up by these, then by each array alone."""
    arrays: list  # numbers of each group
    groups: list  # of a group, places of its arrays, the last one changing fastest
    sizes: list  # byte values of each array


def joint(arrays: Sequence[np.ndarray]) -> Joint:
    sizes = [int(x.max()) + 1 if len(x) else 1 for x in arrays]
    groups: list[list[int]] = []
    for k in sorted(range(len(arrays)), key=lambda k: -sizes[k]):
        group = next((x for x in groups if math.prod(sizes[i] for i in x) * sizes[k] <= JOINT_CELLS), None)
        if group is None:
            groups.append(group := [])
        group.append(k)
    numbers = []
    for group in groups:
        number = np.zeros(len(arrays[0]), np.uint16)
        for k in group:
            number *= np.uint16(sizes[k])
            number += arrays[k]
        numbers.append(number)
    return Joint(numbers, groups, sizes)


def joint_sums(by: Joint, rows: np.ndarray, weights: Sequence[np.ndarray], count: bool) -> np.ndarray:
    """``bin_sums`` of one node, as (sum, array, byte)."""
    out = np.zeros((len(weights) + count, len(by.sizes), 256))
    blocks = [rows[a : a + JOINT_CELLS] for a in range(0, len(rows), JOINT_CELLS)]
    mine = [[w.take(r) for w in weights] for r in blocks]
    for number, group in zip(by.arrays, by.groups, strict=True):
        shape = [by.sizes[k] for k in group]
        total = np.zeros((len(out), math.prod(shape)))
        for r, block in zip(blocks, mine, strict=True):
            key = number.take(r).astype(np.int64)
            for s, w in enumerate((*block, None) if count else block):
                total[s] += np.bincount(key, w, total.shape[1])
        total = total.reshape(len(out), *shape)
        for d, k in enumerate(group, 1):
            out[:, k, : by.sizes[k]] = total.sum(axis=tuple(x for x in range(1, total.ndim) if x != d))
    return out


def _best_of_bins(parts: list, spec: TreeSpec, column) -> list[tuple]:
    """``best_splits`` from sums by bin: ``parts`` holds (slots ascending, array (sum, node, slot, bin)); ``column(node, slot)`` names the column."""
    found = [(slots, np.cumsum(x, axis=3)) for slots, x in parts if len(slots)]
    total = found[0][1][:, :, 0, -1]
    none = [None] * (3 - len(total))  # no counts
    gains = [_gains(*x, *none, *(t[:, None, None] for t in total), *none, spec).reshape(total.shape[1], -1) for _, x in found]
    top = np.max([x.max(axis=1) for x in gains], axis=0)
    out = []
    for v, (g, h, *n) in enumerate(total.T.tolist()):
        whole = (g, h, int(n[0]) if n else 0)
        if not top[v] > 1e-9 * max(1.0, abs(g)):
            out.append((whole, NONE))
            continue
        best = None
        for (slots, x), gain in zip(found, gains, strict=True):
            near, w = gain[v] >= top[v] * (1 - 1e-10), x.shape[3]  # ties to the first column and bin, also after another order of summing
            i = int(np.argmax(near))
            if near[i] and (best is None or slots[i // w] < best[0]):
                best = (int(slots[i // w]), i % w, *x[:, v, i // w, i % w].tolist())
        out.append((whole, (float(top[v]), int(column(v, best[0])), best[1], best[2], best[3], 0 if none else int(best[4]))))
    return out


def packed_splits(sums: np.ndarray, wide: Sequence[int], lay: Layout, columns: np.ndarray, spec: TreeSpec) -> list[tuple]:
    """``best_splits`` of nodes that share ``columns``, from ``bin_sums`` over ``wide`` and all packs."""
    parts = [(np.array(wide, int), sums[:, :, : len(wide)])]
    if lay.packs:
        each = [(sums[:, :, len(wide) + k] @ to).reshape(*sums.shape[:2], -1, NARROW) for k, to in enumerate(lay.spread)]
        on = np.isin(lay.narrow, columns)
        parts.append((lay.narrow[on], np.concatenate(each, axis=2)[:, :, on]))
    return _best_of_bins(parts, spec, lambda v, c: c)


@dataclass
class Known:
    """What the levels of a tree share: the arrays to add up, and sums of split nodes, from which the larger child's follow."""
    lay: Layout
    arrays: list  # all wide columns, then the packs
    joint: Joint | None = None
    count: bool = True  # whether rows are counted
    least: int = 1 << 62  # rows a node from which its sums are kept
    sums: dict = field(default_factory=dict)  # by node
    parent: dict = field(default_factory=dict)  # of the nodes that are wanted
    nodes: Sequence[int] = ()


def level_splits(codes: np.ndarray, rows: np.ndarray, at: np.ndarray, slots: np.ndarray, g: np.ndarray, h: np.ndarray | None, spec: TreeSpec, width: np.ndarray,
                 votes: tuple[float, float] | None = None, known: Known | None = None, draws: np.ndarray | None = None) -> list[tuple]:
    """Sums and best splits of the nodes ``at`` (ascending) of ``rows``, some nodes at a time so that the cells stay few. With ``votes``, ``g`` counts both classes."""
    nodes, q = slots.shape
    same = spec.node_columns is None or spec.node_columns >= q and bool((slots == slots[0]).all())
    if not same and votes is not None and draws is not None and q:
        return vote_splits(codes, rows, at, slots, draws, spec, width, votes)
    if same and known is None:
        lay = layout(width)
        known = Known(lay, lay.arrays(codes))
    weights = [x for x in (g, h) if x is not None]
    dense = PACKED_ROWS if same else DENSE_ROWS
    chunk = DRAWN_CELLS if not same else BOOST_CELLS if votes is None else CHUNK_CELLS
    begin, out, a = np.searchsorted(at, np.arange(nodes + 1, dtype=at.dtype)), [], 0
    spare = begin - dense * np.arange(nodes + 1)
    while a < nodes:
        b = min(nodes, a + max(1, chunk // (max(q, 1) << 8)))
        if b < nodes and spare[b] < spare[a]:  # small nodes: their cells are as few as their rows
            last = max(b, min(nodes, int(np.searchsorted(begin, begin[a] + CHUNK_CELLS // max(q, 1)))))
            over = np.flatnonzero(spare[b : last + 1] >= spare[a])
            b = b + int(over[0]) if len(over) else last
        if same and known.parent and b < nodes and known.parent[known.nodes[b]] == known.parent[known.nodes[b - 1]]:
            b += 1  # siblings stay together
        r, v = rows[begin[a]:begin[b]], at[begin[a]:begin[b]] - a
        if not q or len(r) < dense * (b - a):
            out += best_splits(*cells_of(codes, slots[a:b], v, g[r], None if h is None else h[r], r), slots[a:b], spec, votes)
        elif same:
            out += _shared_splits(known, rows, begin, a, b, weights, votes, slots[0], spec)
        else:
            flat = codes.T.reshape(-1)
            sums = bin_sums([codes[:, c] for c in slots[a]], r, v, 1, weights, votes) if b - a == 1 else _drawn_sums(flat, len(codes), r, v, slots[a:b], weights, votes)
            out += _best_of_bins([(np.arange(q), sums)], spec, lambda k, s, a=a: slots[a + k, s])
        a = b
    return out


def _drawn_sums(flat: np.ndarray, n: int, rows: np.ndarray, at: np.ndarray, slots: np.ndarray, weights: Sequence[np.ndarray], votes: tuple[float, float] | None) -> np.ndarray:
    """``bin_sums`` of nodes with columns of their own; ``flat`` holds the bins of ``n`` rows column by column."""
    out = np.zeros((len(weights) + 1, *slots.shape, 256))
    for a in range(0, len(rows), BLOCK_ROWS):
        r, v = rows[a : a + BLOCK_ROWS], at[a : a + BLOCK_ROWS]
        mine = [w[r] for w in weights]
        u, e = int(v[0]), int(v[-1]) + 1
        base, size = (v - u) << 8, (e - u) << 8
        for k in range(slots.shape[1]):
            key = flat.take(slots[v, k] * n + r) + base
            for i, w in enumerate((*mine, None)):
                out[i, u:e, k] += np.bincount(key, w, size).reshape(-1, 256)
    return out if votes is None else np.stack((*_decoded(out[0], votes), out[1]))


GATHER = 16
VOTE_ROWS = 64  # rows a node from which all bins of its drawn columns are written out
VOTE_BLOCK = (1 << 15) - 1  # rows of nodes that are worked out at once
_FIELDS = (34, 15)  # where positive and negative weights begin in a number that counts both and, below, rows: VOTE_BLOCK rows of weight 12 fit
_VOTES = np.array([((i >> 1) << _FIELDS[1 - (i & 1)]) + 1 for i in range(32)])  # of a row that counts i >> 1 times with label i & 1


def _fields(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> _FIELDS[0], x >> _FIELDS[1] & (1 << _FIELDS[0] - _FIELDS[1]) - 1, x & (1 << _FIELDS[1]) - 1


def vote_splits(codes: np.ndarray, rows: np.ndarray, at: np.ndarray, slots: np.ndarray, draws: np.ndarray, spec: TreeSpec, width: np.ndarray, votes: tuple[float, float]) -> list[tuple]:
    """``level_splits`` of a forest's nodes with columns of their own. ``draws``: twice a row's count, plus its label; all sums of a cell are added up as one number."""
    nodes = len(slots)
    size = np.bincount(at, minlength=nodes)
    out: list = [((0.0, 0.0, 0), NONE)] * nodes
    dense = size >= VOTE_ROWS
    for on, splits in ((dense, _dense_votes), (~dense & (size > 0), _sparse_votes)):
        if on.any():
            mine = rows if on.all() else rows[np.repeat(on, size)]
            which = np.flatnonzero(on)
            for v, found in zip(which.tolist(), splits(codes.T.reshape(-1), len(codes), mine, size[which], slots[which], draws, spec, width, votes), strict=True):
                out[v] = found
    return out


def _vote_sums(fields: Sequence[np.ndarray], votes: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    positive = votes[0] * fields[0]
    return -positive, positive + votes[1] * fields[1], fields[2]


def _dense_votes(flat: np.ndarray, n: int, rows: np.ndarray, size: np.ndarray, slots: np.ndarray, draws: np.ndarray, spec: TreeSpec, width: np.ndarray, votes: tuple[float, float]) -> list[tuple]:
    """Some nodes at a time, each column in as many cells as it has bins; cells in the order (slot, node, bin)."""
    q, out, a = slots.shape[1], [], 0
    weight = _VOTES.astype(np.float64)
    begin = np.append(0, np.cumsum(size))
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + VOTE_BLOCK, side="right")) - 1)
        r, mine, nodes = rows[begin[a]:begin[b]], np.ascontiguousarray(slots[a:b].T), b - a
        wide = width[mine].ravel()
        start = np.cumsum(wide) - wide
        ends = np.append(start[::nodes], start[-1] + wide[-1])
        if nodes == 1 and len(r) > VOTE_BLOCK:  # counts may outgrow their fields: they are kept apart
            sums = np.zeros((3, ends[-1]), np.int64)
            for i in range(0, len(r), VOTE_BLOCK):
                some = r[i : i + VOTE_BLOCK]
                w = weight.take(draws.take(some))
                for k in range(q):
                    c = mine[k, 0]
                    sums[:, ends[k]:ends[k + 1]] += _fields(np.bincount(flat[c * n : c * n + n].take(some), w, wide[k]).astype(np.int64))
            fields = np.cumsum(sums, axis=1)
            fields -= np.repeat(fields[:, start] - sums[:, start], wide, axis=1)
        else:
            cells, w, count = np.empty(ends[-1], np.int64), weight.take(draws.take(r)), size[a:b]
            for k in range(q):
                key = flat.take(np.repeat(mine[k] * n, count) + r) + np.repeat(start[k * nodes : (k + 1) * nodes] - ends[k], count)
                cells[ends[k]:ends[k + 1]] = np.bincount(key, w, ends[k + 1] - ends[k])
            total = np.cumsum(cells)
            total -= np.repeat(total[start] - cells[start], wide)
            fields = _fields(total)
        gl, hl, nl = _vote_sums(fields, votes)
        last = (start + wide - 1)[:nodes]
        whole = [x[last] for x in (gl, hl, nl)]
        gain = _gains(gl, hl, nl, *(np.repeat(np.tile(x, q), wide) for x in whole), spec)
        best = np.maximum.reduceat(gain, start).reshape(q, nodes)
        top = best.max(axis=0)
        top[~(top > 1e-9 * np.maximum(1.0, np.abs(whole[0])))] = 0.0
        least = np.where(top > 0, top * (1 - 1e-10), np.inf)  # ties to the first column and bin, also after another order of summing
        near = np.flatnonzero(gain >= np.repeat(np.tile(least, q), wide))
        having = np.flatnonzero(top > 0)
        k = (best[:, having] >= least[having]).argmax(axis=0)
        first = start[k * nodes + having]
        i = near[np.searchsorted(near, first)]
        found = [(x, NONE) for x in zip(*(x.tolist() for x in whole), strict=True)]
        for v, *split in zip(having.tolist(), top[having].tolist(), mine[k, having].tolist(), (i - first).tolist(), gl[i].tolist(), hl[i].tolist(), nl[i].tolist(), strict=True):
            found[v] = (found[v][0], tuple(split))
        out += found
        a = b
    return out


def _sparse_votes(flat: np.ndarray, n: int, rows: np.ndarray, size: np.ndarray, slots: np.ndarray, draws: np.ndarray, spec: TreeSpec, width: np.ndarray, votes: tuple[float, float]) -> list[tuple]:
    """Small nodes: (node, slot, bin, draw) of every row and slot are sorted as one number, so that the cells that have rows lie side by side."""
    q, out, a = slots.shape[1], [], 0
    begin = np.append(0, np.cumsum(size))
    step = max(1, CHUNK_CELLS // q)
    while a < len(size):
        b = min(a + step, max(a + 1, int(np.searchsorted(begin, begin[a] + step, side="right")) - 1))
        r, count, nodes = rows[begin[a]:begin[b]], size[a:b], b - a
        mine = draws.take(r)
        keys = np.empty((q, len(r)), np.uint32 if nodes * q <= 1 << 18 else np.int64)
        for k in range(q):
            code = flat.take(np.repeat(slots[a:b, k] * n, count) + r).astype(keys.dtype)
            code += np.repeat(((np.arange(nodes) * q + k) << 8).astype(keys.dtype), count)
            keys[k] = (code << 5) | mine
        key = np.sort(keys.ravel())
        upto = np.cumsum(_VOTES.take(key & 31))
        key >>= 5
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        cell, upto = key[end].astype(np.int64), upto[end]
        slot = cell >> 8
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
        span = np.diff(last, prepend=-1)
        upto -= np.repeat(np.append(0, upto[last[:-1]]), span)
        gl, hl, nl = _vote_sums(_fields(upto), votes)
        lead = last[::q]  # every slot of a node has its sums
        whole = [x[lead] for x in (gl, hl, nl)]
        cells = span.reshape(-1, q).sum(axis=1)
        first = np.cumsum(cells) - cells
        gain = _gains(gl, hl, nl, *(np.repeat(x, cells) for x in whole), spec)
        gain[last] = 0.0
        top = np.maximum.reduceat(gain, first)
        top[~(top > 1e-9 * np.maximum(1.0, np.abs(whole[0])))] = 0.0
        least = np.where(top > 0, top * (1 - 1e-10), np.inf)
        near = np.flatnonzero(gain >= np.repeat(least, cells))
        having = np.flatnonzero(top > 0)
        i = near[np.searchsorted(near, first[having])]
        found = [(x, NONE) for x in zip(*(x.tolist() for x in whole), strict=True)]
        for v, *split in zip(having.tolist(), top[having].tolist(), slots[a + having, slot[i] % q].tolist(), (cell[i] & 255).tolist(), gl[i].tolist(), hl[i].tolist(), nl[i].tolist(), strict=True):
            found[v] = (found[v][0], tuple(split))
        out += found
        a = b
    return out


def _shared_splits(known: Known, rows: np.ndarray, begin: np.ndarray, a: int, b: int, weights: Sequence[np.ndarray], votes: tuple[float, float] | None, columns: np.ndarray, spec: TreeSpec) -> list[tuple]:
    """Splits of the nodes ``a`` to ``b`` of a level; of two siblings with known sums of their parent, the larger one's are the rest."""
    drawn = set(columns.tolist())
    on = [k for k, c in enumerate(known.lay.wide) if c in drawn]
    arrays = [known.arrays[k] for k in on] + known.arrays[len(known.lay.wide) :]
    size = np.diff(begin)
    rest = {}  # the larger sibling -> (the smaller one, parent)
    for i in range(a, b - 1):
        if known.parent and (p := known.parent[known.nodes[i]]) in known.sums and known.parent[known.nodes[i + 1]] == p:
            small, large = (i, i + 1) if size[i] <= size[i + 1] else (i + 1, i)
            rest[large] = small, p
    read = [i for i in range(a, b) if i not in rest]
    r = rows[begin[a]:begin[b]] if not rest else np.concatenate([rows[begin[i]:begin[i + 1]] for i in read])
    own = np.empty((3 if known.count else 2, len(read), len(arrays), 256))
    places = [*on, *range(len(known.lay.wide), len(known.arrays))]
    large = [i for i, v in enumerate(read) if known.joint and size[v] >= JOINT_ROWS]
    for i in large:
        found = joint_sums(known.joint, rows[begin[read[i]]:begin[read[i] + 1]], weights, known.count)[:, places]
        own[:, i] = found if votes is None else np.stack((*_decoded(found[0], votes), found[1]))
    if small := [i for i in range(len(read)) if i not in large]:
        if large:
            r = np.concatenate([rows[begin[read[i]]:begin[read[i] + 1]] for i in small])
        own[:, small] = bin_sums(arrays, r, np.repeat(np.arange(len(small)), size[read][small]), len(small), weights, votes, count=known.count)
    sums = own
    if rest:
        sums = np.empty((len(own), b - a, *own.shape[2:]))
        sums[:, [i - a for i in read]] = own
        for large, (small, p) in rest.items():
            np.subtract(known.sums[p], sums[:, small - a], out=sums[:, large - a])
    for i in range(a, b):
        if size[i] >= known.least:
            known.sums[known.nodes[i]] = sums[:, i - a].copy()
    return packed_splits(sums, [known.lay.wide[k] for k in on], known.lay, columns, spec)


def grower(tree: Tree, spec: TreeSpec) -> Generator[list[int], dict[int, tuple], None]:
    """Grows ``tree``; yields the nodes whose splits it wants and is sent ``{node: (sums, split)}``."""
    found = yield [0]
    tree.sums[0] = found[0][0]

    def may_split(v: int, depth: int) -> bool:
        g, h, n = tree.sums[v]
        if spec.kind != "boost" and min(-g, g + h) <= 1e-10 * h:  # one class is left: no split gains anything
            return False
        return (spec.depth is None or depth < spec.depth) and (not counted(spec) or n >= 2 * spec.least_rows) and h >= 2 * spec.least_hessian

    if spec.leaves is None:
        level, depth = [0], 0
        while level and (spec.depth is None or depth < spec.depth):
            depth += 1
            kids = [k for v in level if found[v][1][0] > 0 for k in tree.split(v, found[v][1])]
            level = [k for k in kids if may_split(k, depth)]
            if level:
                found = yield level
        return
    heap, leaves = [(-found[0][1][0], 0, 0, found[0][1])], 1
    while heap and leaves < spec.leaves:
        gain, v, depth, best = heapq.heappop(heap)
        if gain == 0:
            return
        leaves += 1
        kids = [k for k in tree.split(v, best) if may_split(k, depth + 1)]
        if kids and leaves < spec.leaves:
            found = yield kids
            for k in kids:
                heapq.heappush(heap, (-found[k][1][0], k, depth + 1, found[k][1]))


# --------------------------------------------------------------------------- models
@dataclass(frozen=True)
class Bins:
    """What turns rows into bins: per column ascending edges (bin k holds values in (edge[k-1], edge[k]]) and the median for missing values."""
    edges: list
    fill: list

    def codes(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.zeros((len(x), 0), np.uint8)
        out = np.empty((len(x), len(self.edges)), np.uint8, order="F")
        for j, (e, f) in enumerate(zip(self.edges, self.fill, strict=True)):
            out[:, j] = np.searchsorted(e, np.where(np.isnan(x[:, j]), f, x[:, j]), side="left")
        return out


@dataclass
class Ensemble:
    """Trees over binned columns."""
    spec: TreeSpec
    base: float
    bins: Bins | None
    trees: list = field(default_factory=list)

    def margin(self, codes: np.ndarray, trees: Sequence[Tree] | None = None) -> np.ndarray:
        out = np.full(len(codes), self.base if trees is None else 0.0)
        for t in self.trees if trees is None else trees:
            out += t.values(self.spec)[t.routed(codes)]
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        m = self.margin(codes)
        return 1 / (1 + np.exp(-m)) if self.spec.kind == "boost" else np.clip(m / max(1, len(self.trees)), 0.0, 1.0)


def class_weights(y: np.ndarray, spec: TreeSpec) -> np.ndarray:
    if not spec.balanced or not len(y):
        return np.ones(len(y))
    count = np.bincount(y.astype(np.int64), minlength=2)
    return (len(y) / (2.0 * np.maximum(count, 1)))[y.astype(np.int64)]


def _base(positive: float, n: float, spec: TreeSpec) -> float:
    share = min(max(positive / n if n else 0.5, 1e-12), 1 - 1e-12)
    return math.log(share / (1 - share)) if spec.kind == "boost" else 0.0


def _slopes(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, spec: TreeSpec) -> tuple[np.ndarray, np.ndarray]:
    if spec.kind != "boost":
        return -y * weight, weight
    g, h = np.empty(len(margin)), np.empty(len(margin))
    for a in range(0, len(margin), BLOCK_ROWS):
        on = slice(a, a + BLOCK_ROWS)
        p, w = 1 / (1 + np.exp(-margin[on])), weight if np.isscalar(weight) else weight[on]
        g[on], h[on] = (p - y[on]) * w, np.maximum(p * (1 - p), 1e-16) * w
    return g, h


def _handed_down(codes: np.ndarray, tree: Tree, rows_of: dict[int, np.ndarray], wanted: list[int]) -> None:
    """Hands the rows of split nodes to their children; those that are not wanted are only kept if the tree grows best first."""
    for v in [v for v in rows_of if tree.feature[v] >= 0]:
        rows = rows_of.pop(v)
        low = codes[:, tree.feature[v]].take(rows) <= tree.cut[v]
        rows_of[tree.left[v]], rows_of[tree.right[v]] = rows.compress(low), rows.compress(~low)


def _next_level(codes: np.ndarray, tree: Tree, rows: np.ndarray, at: np.ndarray, nodes: list[int], wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``_handed_down`` for levels of many small nodes, in one go: (rows, place in ``wanted``), ordered by place and row."""
    feature, cut, left, right = (np.array([x[v] for v in nodes]) for x in (tree.feature, tree.cut, tree.left, tree.right))
    on = feature[at] >= 0
    rows, at = rows[on], at[on]
    place = np.full(len(tree.feature), -1)
    place[wanted] = np.arange(len(wanted))
    to = place[np.where(codes[rows, feature[at]] <= cut[at], left[at], right[at])]
    on = to >= 0
    both = np.sort(to[on] << 32 | rows[on])
    return both & 0xFFFFFFFF, both >> 32


def _gathered(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """These rows side by side, a column at a time."""
    out = np.empty((len(rows), codes.shape[1]), np.uint8, order="F")
    for j in range(codes.shape[1]):
        codes[:, j].take(rows, out=out[:, j], mode="clip")
    return out


def train(codes: np.ndarray, y: np.ndarray, ids: np.ndarray, bins: Bins, spec: TreeSpec, rounds: Sequence[int] | None = None) -> Ensemble:
    """One model on the rows at hand; of a forest, the trees of ``rounds`` alone if given."""
    out = Ensemble(spec, _base(float(y.sum()), len(y), spec), bins)
    codes = np.asfortranarray(codes)
    width = codes.max(axis=0).astype(np.int64) + 1 if len(codes) else np.ones(codes.shape[1], np.int64)
    margin, class_weight, place = np.full(len(y), out.base), class_weights(y, spec) if spec.balanced else 1.0, np.int32 if len(y) < 1 << 31 else np.int64
    lay = layout(width)
    arrays = lay.arrays(codes) if spec.node_columns is None else []
    several = joint(arrays) if arrays and len(codes) >= JOINT_ROWS else None
    for r in range(spec.rounds) if rounds is None else rounds:
        times = row_weights(ids, spec, r)
        votes = draws = None
        if spec.kind == "forest":
            draws = (times * 2 + (y > 0)).astype(np.uint8)
        if spec.kind != "boost" and times.sum() < VOTE:
            votes = tuple(float(class_weight[y == c][0]) if spec.balanced and (y == c).any() else 1.0 for c in (1, 0))
            g, h = times * np.where(y > 0, VOTE, 1.0), None
        else:
            g, h = _slopes(margin, y, class_weight * times if spec.balanced else times, spec)
        columns = tree_columns(codes.shape[1], spec, r)
        tree = Tree()
        growing, found, depth = grower(tree, spec), None, 0
        drawn = rows = np.flatnonzero(times > 0).astype(place)
        del times
        at, nodes, rows_of = None, None, None
        own, laid = codes, 1  # a forest's rows are laid out anew, node by node, at every GATHER times as many nodes
        known = Known(lay, arrays, several, counted(spec), max(512, len(rows) // 128)) if arrays else None
        while True:
            try:
                wanted = growing.send(found)
            except StopIteration:
                break
            depth += 1
            if nodes is None:
                at, rows_of = np.zeros(len(rows), place), {0: rows}
            elif spec.leaves is None and len(rows) < DENSE_ROWS * len(nodes):
                rows, at = (x.astype(place) for x in _next_level(own, tree, rows, at, nodes, wanted))
                rows_of = None
            else:
                if rows_of is None:
                    begin = np.searchsorted(at, np.arange(len(nodes) + 1, dtype=at.dtype))
                    rows_of = {v: rows[begin[i]:begin[i + 1]] for i, v in enumerate(nodes)}
                _handed_down(own, tree, rows_of, wanted)
                rows_of = rows_of if spec.leaves is not None else {v: rows_of[v] for v in wanted}
                rows = np.concatenate([rows_of[v] for v in wanted])
                at = np.repeat(np.arange(len(wanted), dtype=place), [len(rows_of[v]) for v in wanted])
            if known and nodes is not None:
                known.parent = {k: v for v in (nodes if spec.leaves is None else range(len(tree.feature))) if tree.feature[v] >= 0 for k in (tree.left[v], tree.right[v])}
            if known:
                known.nodes = wanted
                if spec.leaves is None and depth == spec.depth:
                    known.least = 1 << 62  # the last level: nobody asks for these sums
            nodes = wanted
            slots = node_columns(columns, spec, r, wanted)
            if draws is not None and votes is not None and len(wanted) >= GATHER * laid:
                own, g, draws, laid = _gathered(own, rows), g[rows], draws[rows], len(wanted)
                rows = np.arange(len(rows), dtype=place)
                if rows_of is not None:
                    begin = np.searchsorted(at, np.arange(len(wanted) + 1, dtype=at.dtype))
                    rows_of = {v: rows[begin[i]:begin[i + 1]] for i, v in enumerate(wanted)}
            found = dict(zip(wanted, level_splits(own, rows, at, slots, g, h, spec, width, votes, known, draws), strict=True))
            if known:
                for v in set(known.parent.values()) & known.sums.keys():
                    del known.sums[v]
        out.trees.append(tree)
        if spec.kind == "boost":
            node = tree.routed(codes)
            values = tree.values(spec)
            for a in range(0, len(margin), BLOCK_ROWS):
                margin[a : a + BLOCK_ROWS] += values[node[a : a + BLOCK_ROWS]]
            if not counted(spec):
                _with_counts(tree, np.bincount(node[drawn], minlength=len(tree.feature)).tolist())
    return out


def _with_counts(tree: Tree, n: list[int]) -> None:
    """Fills in the rows of all nodes from those of the leaves."""
    for v in range(len(n) - 1, -1, -1):  # children come after their parent
        if tree.feature[v] >= 0:
            n[v] = n[tree.left[v]] + n[tree.right[v]]
        tree.sums[v] = (*tree.sums[v][:2], n[v])


# --------------------------------------------------------------------------- frames
@dataclass(frozen=True)
class Task:
    """A model to train: on the rows outside ``fold`` (all rows if None)."""
    name: str
    fold: int | None
    spec: TreeSpec


def column(name: str):
    """The column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


SUMMARY = 1 << 15  # values that a column of a fold's rows keeps in a task: the ranks of quantiles are right to this share
SUMMARY_CELLS = 1 << 23  # values that a task holds before they are summed up: 64 MB
_SUMMARY = T.StructType([T.StructField("j", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("value", T.BinaryType()), T.StructField("rows", T.BinaryType())])
_CUTS = T.StructType([T.StructField("j", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.DoubleType()))])


def _summary(value: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values and how many rows each stands for; of more than SUMMARY different ones, those at as many equal steps of rank."""
    if rows is None:
        value = np.sort(value)
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, int)
        rows = np.diff(np.append(first, len(value)))
    else:
        order = np.argsort(value, kind="stable")
        value, rows = value[order], rows[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, int)
        rows = np.add.reduceat(rows, first) if len(first) else rows
    value = value[first]
    if len(value) > SUMMARY:
        upto = np.cumsum(rows)
        at = np.unique(np.searchsorted(upto, np.ceil(np.arange(1, SUMMARY + 1) * (upto[-1] / SUMMARY)).clip(1, upto[-1])))
        value, rows = value[at], np.diff(upto[at], prepend=0)
    return value, rows


def fit_bins(df: DataFrame, columns: Sequence[str], fold: str | None, folds: Sequence[int | None]) -> dict:
    """{fold: Bins}, from the rows outside each fold.

    Each task sums up every column of every fold's rows once (``_summary``); a column's summaries meet in a task, which reads the
    quantiles outside each fold from the other folds' summaries. They are exact up to SUMMARY different values in a task.
    """
    p, folds = len(columns), list(folds)
    probs = np.array([k / BINS for k in range(1, BINS)])
    values = df.select((F.lit(None) if fold is None else F.col(fold)).cast("int"), *[column(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int | None], tuple] = {}
        waiting: list[pa.RecordBatch] = []

        def close() -> None:
            if not waiting:
                return
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            of = table.column(0)
            missing, number = of.is_null().to_numpy(), of.fill_null(0).to_numpy()
            groups = [(f, np.flatnonzero(missing if f is None else ~missing & (number == f))) for f in of.unique().to_pylist()]
            for j in range(p):
                x = table.column(j + 1)
                there, x = x.is_valid().to_numpy() if x.null_count else None, x.to_numpy()
                for f, on in groups:
                    new = _summary(x[on] if there is None else x[on[there[on]]])
                    old = known.get((j, f))
                    known[j, f] = new if old is None else _summary(*(np.concatenate(v) for v in zip(old, new, strict=True)))

        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) * p >= SUMMARY_CELLS:
                close()
        close()
        for (j, f), (value, rows) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([f], pa.int32()), pa.array([value.tobytes()], pa.binary()), pa.array([rows.astype(np.int64).tobytes()], pa.binary())], names=_SUMMARY.names)

    def cut(table: pa.Table) -> pa.Table:
        parts = [(f, np.frombuffer(v), np.frombuffer(r, np.int64)) for f, v, r in zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        value, rows = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
        of = np.concatenate([np.full(len(v), len(folds) if f is None else folds.index(f) if f in folds else -1) for f, v, _ in parts])
        order = np.argsort(value, kind="stable")
        value, rows, of = value[order], rows[order], of[order]
        out = []
        for i, f in enumerate(folds):  # rows of no fold count for models of all rows alone
            upto = np.cumsum(rows if f is None else np.where((of != i) & (of != len(folds)), rows, 0))
            n = int(upto[-1]) if len(upto) else 0
            out.append({"j": table.column(0)[0].as_py(), "fold": f, "cuts": value[np.searchsorted(upto, np.ceil(probs * n).clip(1))].tolist() if n else []})
        return pa.Table.from_pylist(out, schema=pa.schema([("j", pa.int32()), ("fold", pa.int32()), ("cuts", pa.list_(pa.float64()))]))

    found = {(r.fold, r.j): np.array(r.cuts or [0.0], float) for r in values.mapInArrow(sum_up, _SUMMARY).groupBy("j").applyInArrow(cut, _CUTS).collect()}  # BINS values a column and fold
    out = {}
    for f in folds:
        cuts = [found.get((f, j), np.zeros(1)) for j in range(p)]
        out[f] = Bins([np.unique(e) for e in cuts], [float(e[len(e) // 2]) for e in cuts])
    return out


def _frame(df: DataFrame, columns: Sequence[str], label: str, key: str, fold: str | None) -> DataFrame:
    values = F.array(*[F.coalesce(column(c).cast("double"), F.lit(float("nan"))) for c in columns])
    return df.select(F.xxhash64(F.col(key)).alias("id"), F.col(key).cast("string").alias("k"), F.col(label).cast("double").alias("y"),
                     (F.lit(-1) if fold is None else F.coalesce(F.col(fold), F.lit(-1))).cast("int").alias("fold"), values.alias("x"))


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


_SCORES = T.StructType([T.StructField("model", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("k", T.StringType()),
                        T.StructField("label", T.IntegerType()), T.StructField("p", T.DoubleType())])


def fits_tasks(df: DataFrame, columns: Sequence[str]) -> bool:
    return df.count() * max(1, len(columns)) <= LOCAL_CELLS


@dataclass
class Local:
    """All rows with their bins under the edges of all folds together, in the order of their ids; ``tables`` turns these into a fold's own bins."""
    ids: np.ndarray
    keys: pa.Array
    y: np.ndarray
    fold: np.ndarray
    codes: np.ndarray
    tables: dict

    def under(self, fold: int | None, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.codes.shape[1]), np.uint8, order="F")
        for j, to in enumerate(self.tables[fold]):
            out[:, j] = to.take(self.codes[:, j].take(rows))
        return out


def _all_edges(bins: dict) -> tuple[list, dict, np.dtype]:
    """The edges of all folds together, what turns bins under these into a fold's own, and the type of their numbers."""
    p = len(next(iter(bins.values())).edges)
    edges = [np.unique(np.concatenate([b.edges[j] for b in bins.values()])) for j in range(p)]
    # a value's bin under all edges fixes its bin under some of them; missing values, a fold's median, have the last number
    tables = {f: [np.searchsorted(b.edges[j], np.append(e, [np.inf, b.fill[j]]), side="left").astype(np.uint8) for j, e in enumerate(edges)] for f, b in bins.items()}
    for f, b in bins.items():
        for j, e in enumerate(edges):
            tables[f][j][len(e)] = len(b.edges[j])
    return edges, tables, np.min_scalar_type(max((len(e) + 1 for e in edges), default=0))


def _collected(rows: DataFrame, bins: dict) -> Local:
    """Tasks turn values into bins, so that two bytes a cell reach the driver, once for all folds: LOCAL_CELLS at most, callers check."""
    edges, tables, kind = _all_edges(bins)
    p = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(4), p)
                codes = np.empty((p, len(x)), kind)
                for j, e in enumerate(edges):
                    codes[j] = np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], side="left"))
                keys = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(1))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([v.tobytes()], pa.binary()) for v in (b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), codes))], names=["k", "id", "y", "fold", "codes"])

    table = rows.mapInArrow(run, "k array<string>, id binary, y binary, fold binary, codes binary").toArrow()
    blocks = {c: [x.as_buffer() for x in table.column(c)] for c in table.column_names[1:]}
    ids, y, fold = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in blocks[c])]) for c, t in (("id", np.int64), ("y", np.float64), ("fold", np.int32)))
    order = np.argsort(ids, kind="stable")
    codes = np.empty((len(ids), p), kind, order="F")
    for j in range(p):
        codes[:, j] = np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind).reshape(p, -1)[j] for x in blocks["codes"])])[order]
    keys = pa.concat_arrays([pa.array([], pa.string()), *(x.flatten() for x in table.column("k").chunks)])
    return Local(ids[order], keys.take(pa.array(order)), y[order], fold[order], codes, tables)


def _parts(spec: TreeSpec) -> list[list[int]]:
    """Rounds that are trained together: all of them, or those of FOREST_PART trees."""
    step = FOREST_PART if spec.kind == "forest" else max(1, spec.rounds)
    return [list(range(a, min(a + step, spec.rounds))) for a in range(0, max(1, spec.rounds), step)]


_PART_SCORES = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), *_SCORES.fields])


def in_tasks(rows: DataFrame, tasks: Sequence[Task], bins: dict) -> DataFrame:
    """(model, fold, k, label, p) of each task's held-out rows; whole models, or some trees of a forest, are trained in tasks over broadcast rows."""
    spark, todo = rows.sparkSession, list(tasks)
    shared = spark.sparkContext.broadcast(_collected(rows, bins))
    pieces = [(i, j, part) for i, t in enumerate(todo) for j, part in enumerate(_parts(t.spec))]
    pieces.sort(key=lambda x: -len(x[2]) * (todo[x[0]].spec.depth or 12))  # the longest first; one a partition, so that none waits for another

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                i, j, part = pieces[at]
                task = todo[i]
                data = shared.value
                on = np.ones(len(data.y), bool) if task.fold is None else data.fold != task.fold
                off = np.flatnonzero(on if task.fold is None else ~on)
                on = np.flatnonzero(on)
                model = train(data.under(task.fold, on), data.y[on], data.ids[on], bins[task.fold], task.spec, part)
                held = data.under(task.fold, off)
                p = model.probability(held) if task.spec.kind == "boost" else model.margin(held)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(off), i, np.int32)), pa.array(np.full(len(off), j, np.int32)), pa.array(off), pa.array([task.name] * len(off)),
                    pa.array(np.full(len(off), -1 if task.fold is None else task.fold, np.int32)), data.keys.take(pa.array(off)) if j == 0 else pa.nulls(len(off), pa.string()), pa.array(data.y[off].astype(np.int32)), pa.array(p)], names=_PART_SCORES.names)

    return _added(spark.range(0, len(pieces), 1, len(pieces)).mapInArrow(run, _PART_SCORES), todo)


def _added(found: DataFrame, todo: Sequence[Task]) -> DataFrame:
    """Scores of the tasks; those of a forest's parts added up."""
    forests = [i for i, t in enumerate(todo) if t.spec.kind != "boost"]
    if not forests:
        return found.select(*_SCORES.names)
    if len(forests) < len(todo):
        found = found.checkpoint()  # read twice below
    trees = F.get(F.array(*[F.lit(float(max(1, t.spec.rounds))) for t in todo]), F.col("task"))
    added = found.where(F.col("task").isin(forests)).groupBy("task", "at").agg(
        F.array_sort(F.collect_list(F.struct("part", "p"))).alias("parts"), *[F.first(c, ignorenulls=True).alias(c) for c in _SCORES.names[:-1]])
    share = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["p"]) / trees  # added up in the order of the trees
    added = added.select(*_SCORES.names[:-1], F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("p"))
    return added if len(forests) == len(todo) else added.unionByName(found.where(~F.col("task").isin(forests)).select(*_SCORES.names))


_READ = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("y", T.DoubleType()),
                      T.StructField("fold", T.IntegerType()), T.StructField("codes", T.BinaryType())])
OUT_ROWS = 1 << 16  # scores that a task hands on at once


def _dealt(todo: Sequence[Task], slots: int) -> list[list[tuple[int, int, list[int]]]]:
    """(task, part, rounds) that are trained one after another over the rows of one fold: some lists a fold, of like work, the longest first."""
    out = []
    folds = list(dict.fromkeys(t.fold for t in todo))
    for f in folds:
        pieces = [(i, j, part) for i, t in enumerate(todo) if t.fold == f for j, part in enumerate(_parts(t.spec))]
        lists: list = [[0, []] for _ in range(min(len(pieces), math.ceil(4 * slots / len(folds))))]
        for piece in sorted(pieces, key=lambda x: -len(x[2]) * (todo[x[0]].spec.depth or 12)):
            least = min(lists, key=lambda x: x[0])
            least[0] += len(piece[2]) * (todo[piece[0]].spec.depth or 12)
            least[1].append(piece)
        out += lists
    return [sorted(x) for _, x in sorted(out, key=lambda x: -x[0])]


def by_reading(rows: DataFrame, tasks: Sequence[Task], bins: dict) -> DataFrame:
    """``in_tasks`` for more rows: each task reads those of its fold from a checkpoint of bins and keeps a byte a cell."""
    todo, (edges, tables, kind) = list(tasks), _all_edges(bins)
    p = len(edges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(4), p)
                codes = np.empty((len(x), p), kind)
                for j, e in enumerate(edges):
                    codes[:, j] = np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], side="left"))
                size = p * codes.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([b.column(5), *(b.column(i) for i in range(4)), packed], names=_READ.names)

    state = rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(encode, _READ).checkpoint()
    counts = {r.fold: r["count"] for r in state.groupBy("fold").count().collect()}  # one row a fold

    def read(batches: Iterator[pa.RecordBatch], fold: int | None) -> tuple:
        """Training and held-out rows: (codes, place, id, label, key) each, in the order of their ids."""
        n = [sum(c for f, c in counts.items() if (fold is None or f != fold) == part) for part in (True, False)]
        if fold is None:
            n[1] = n[0]
        out = [(np.empty((m, p), np.uint8, order="F"), np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.uint8), []) for m in n]
        end = [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            at, ids, y, of = (b.column(i).to_numpy() for i in (0, 1, 3, 4))
            first = np.frombuffer(b.column(5).buffers()[1], np.int32)[b.column(5).offset]
            codes = np.frombuffer(b.column(5).buffers()[2], np.uint8)[first:first + len(at) * p * kind.itemsize].view(kind).reshape(len(at), p)
            train_on = np.ones(len(at), bool) if fold is None else of != fold
            for k, on in enumerate((train_on, train_on if fold is None else ~train_on)):
                m, (x, places, numbers, labels, keys) = int(on.sum()), out[k]
                to = slice(end[k], end[k] + m)
                for j, table in enumerate(tables[fold]):
                    x[to, j] = table.take(codes[on, j])
                places[to], numbers[to], labels[to] = at[on], ids[on], y[on]
                if k:
                    keys.append(b.column(2).filter(pa.array(on)))
                end[k] += m
        done = []
        for k, (x, places, numbers, labels, keys) in enumerate(out):
            order = np.lexsort((places, numbers))
            for j in range(p):
                x[:, j] = x[order, j]
            out[k] = None
            done.append((x, places[order] if k else None, numbers[order], labels[order], pa.concat_arrays([pa.array([], pa.string()), *keys]).take(pa.array(order)) if keys else None))
        return done

    def trained(pieces: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold = todo[pieces[0][0]].fold
            (codes, _, ids, y, _), (held, at, _, labels, keys) = read(batches, fold)
            for i in dict.fromkeys(x[0] for x in pieces):
                task, mine = todo[i], [x for x in pieces if x[0] == i]
                p_held = np.zeros(len(held))
                for _, _, part in mine:
                    model = train(codes, y, ids, bins[fold], task.spec, part)
                    p_held += model.probability(held) if task.spec.kind == "boost" else model.margin(held)
                for a in range(0, len(held), OUT_ROWS):
                    on = slice(a, a + OUT_ROWS)
                    m = len(at[on])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(m, i, np.int32)), pa.array(np.full(m, mine[0][1], np.int32)), pa.array(at[on]), pa.array([task.name] * m), pa.array(np.full(m, -1 if fold is None else fold, np.int32)),
                        keys.slice(a, m) if mine[0][1] == 0 else pa.nulls(m, pa.string()), pa.array(labels[on].astype(np.int32)), pa.array(p_held[on])], names=_PART_SCORES.names)
        return run

    # Spark runs a union of branches of one partition each in one task; an empty branch of two partitions keeps them apart
    found = rows.sparkSession.range(0, 2, 1, 2).mapInArrow(lambda batches: (b for b in batches if False), _PART_SCORES)
    for pieces in _dealt(todo, rows.sparkSession.sparkContext.defaultParallelism):
        found = found.unionAll(state.coalesce(1).mapInArrow(trained(pieces), _PART_SCORES))  # one task that reads all rows, without a shuffle
    return _added(found, todo)


_SPLIT = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("v", T.IntegerType()), *(T.StructField(x, T.DoubleType()) for x in ("g", "h", "n", "gain", "gl", "hl", "nl")),
                       T.StructField("column", T.IntegerType()), T.StructField("cut", T.IntegerType())])
_CELLS = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("v", T.IntegerType()), T.StructField("cells", T.BinaryType())])


_ARROW_CELLS = pa.schema([("m", pa.int32()), ("v", pa.int32()), ("cells", pa.binary())])
_STATE = T.StructType([T.StructField(x, T.BinaryType()) for x in ("id", "y", "fold", "codes", "margins")])
DIRECT_BYTES = 1 << 27  # sums of all tasks that the driver adds up
PART_BYTES = 1 << 26  # rows kept in a partition


def _state(rows: DataFrame, tasks: Sequence[Task], models: list[Ensemble], folds: list, p: int, n: int) -> DataFrame:
    """Blocks of rows: their bins under each fold's edges (fold, column, row) and a margin for each model (model, row)."""
    first = {f: next(m.bins for t, m in zip(tasks, models, strict=True) if t.fold == f) for f in folds}
    bases = np.array([m.base for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(4), p)
                ids, y, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                codes = np.stack([first[f].codes(x).T for f in folds])
                yield _packed([ids, y, fold.astype(np.int32), codes, np.repeat(bases, len(ids))])
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n * (20 + p * len(folds) + 8 * len(tasks)) / PART_BYTES))
    return rows.mapInArrow(run, _STATE).repartition(parts)


def _packed(arrays: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=_STATE.names)


def _unpacked(batches: Iterator[pa.RecordBatch], folds: int, p: int, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of each block: ids, y, fold, bins (fold, column, row), margins (model, row)."""
    for b in batches:
        for i in range(b.num_rows):
            ids, y, fold, codes, margins = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in enumerate((np.int64, np.float64, np.int32, np.uint8, np.float64)))
            yield ids, y, fold, codes.reshape(folds, p, -1), margins.reshape(models, -1)


def _scan(state: DataFrame, parts: int, tasks: list[Task], fold_at: list[int], p: int, lays: list[Layout], weights: list, pending: list, now: list, wanted: dict, r: int, sums: dict) -> dict:
    """Best splits of all wanted nodes of all models: {(model, node): (sums, split)}.

    If the bins of all tasks are at most DIRECT_BYTES, the driver adds them up and keeps those of split nodes (``sums``), so that of two
    siblings only the smaller is read; otherwise the cells of a node meet in a shuffle.
    """
    models, folds = len(tasks), len(lays)
    parent_of = {m: {k: v for v, f in enumerate(now[m].feature) if f >= 0 for k in (now[m].left[v], now[m].right[v])} for m in wanted}
    read, rest = {}, {}
    for m, nodes in wanted.items():
        rest[m] = {}
        for a, b in zip(nodes, nodes[1:]):
            if (parent := parent_of[m].get(a)) == parent_of[m].get(b) and (m, parent) in sums:
                small, large = (a, b) if now[m].sums[a][2] <= now[m].sums[b][2] else (b, a)
                rest[m][large] = small, parent
        read[m] = [v for v in nodes if v not in rest[m]]
    size = sum(len(v) * (len(lays[fold_at[m]].wide) + len(lays[fold_at[m]].packs)) * 256 * 24 for m, v in read.items())
    direct = p > 0 and all(tasks[m].spec.node_columns is None for m in wanted) and size * parts <= DIRECT_BYTES
    if not direct:
        read = wanted
        sums.clear()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        dense: dict[int, np.ndarray] = {}  # of a model with few open nodes: sums by (node, slot, bin), or by (node, array, byte) if direct
        for ids, y, fold, codes, margins in _unpacked(batches, folds, p, models):
            arrays = {f: lays[f].arrays(codes[f].T) for f in {fold_at[m] for m in read}} if direct else {}
            for m, nodes in read.items():
                task, mine = tasks[m], codes[fold_at[m]].T
                times = row_weights(ids, task.spec, r) * (fold != task.fold if task.fold is not None else 1.0)
                place = np.full(len(now[m].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = np.where(times > 0, place[now[m].routed(mine)], -1)
                rows = np.flatnonzero(at >= 0)
                at = at[rows]
                if not len(rows):
                    continue
                ens = Ensemble(task.spec, 0.0, None)
                margin = margins[m] + (ens.margin(mine, pending[m]) if pending[m] else 0.0)
                g, h = _slopes(margin, y, times * np.where(y > 0, *weights[m]), task.spec)
                if direct:
                    order = np.argsort(at.astype(np.int32), kind="stable")
                    total = dense.setdefault(m, np.zeros((3, len(nodes), len(arrays[fold_at[m]]), 256)))
                    bin_sums(arrays[fold_at[m]], rows[order], at[order], len(nodes), (g, h), out=total)
                    continue
                g, h = g[rows], h[rows]
                slots = node_columns(tree_columns(p, task.spec, r), task.spec, r, nodes)
                if slots.size << 8 <= DENSE_CELLS:
                    total = dense.setdefault(m, np.zeros((3, *slots.shape, 256)))
                    for k in range(slots.shape[1]):
                        key = (at << 8) + mine[rows, slots[at, k]]
                        for i, by in enumerate((g, h, None)):
                            total[i, :, k] += np.bincount(key, by, len(nodes) << 8).reshape(-1, 256)
                    continue
                cell, *found = cells_of(mine, slots, at, g, h, rows)
                of = (cell >> 8) // slots.shape[1]
                for k in np.unique(of).tolist():
                    on = of == k
                    old = held.get((m, nodes[k]))
                    part = [cell[on] - (k * slots.shape[1] << 8), *(s[on].astype(float) for s in found)]
                    held[m, nodes[k]] = part if old is None else _merged([old, part])
        if direct:
            yield pa.RecordBatch.from_pylist([{"m": m, "v": -1, "cells": x.tobytes()} for m, x in dense.items()], schema=_ARROW_CELLS)
            return
        for m, total in dense.items():
            for k, v in enumerate(wanted[m]):
                cell = np.flatnonzero(total[2, k])
                if len(cell):
                    held[m, v] = [cell, *(x.ravel()[cell] for x in total[:, k])]
        rows = [{"m": m, "v": v, "cells": np.concatenate([c.view(np.float64) if c.dtype != np.float64 else c for c in (part[0].astype(np.int64), *part[1:])]).tobytes()} for (m, v), part in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_CELLS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_at, parts, out = None, [], []

        def close() -> None:
            if now_at is None:
                return
            m, v = now_at
            cell, g, h, n = _merged(parts)
            slots = node_columns(tree_columns(p, tasks[m].spec, r), tasks[m].spec, r, [v])
            (whole, split), = best_splits(cell, g, h, n, slots, tasks[m].spec)
            out.append({"m": m, "v": v, **dict(zip(("g", "h", "n"), map(float, whole), strict=True)), "gain": split[0], "column": split[1], "cut": split[2], **dict(zip(("gl", "hl", "nl"), map(float, split[3:]), strict=True))})

        for b in batches:
            for row in b.to_pylist():
                if now_at != (row["m"], row["v"]):
                    close()
                    now_at, parts = (row["m"], row["v"]), []
                x = np.frombuffer(row["cells"], np.float64).reshape(4, -1)
                parts = [_merged([*parts, [x[0].view(np.int64), *x[1:]]])]
        close()
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("m", pa.int32()), ("v", pa.int32()), *((x, pa.float64()) for x in ("g", "h", "n", "gain", "gl", "hl", "nl")), ("column", pa.int32()), ("cut", pa.int32())]))

    found = state.mapInArrow(add, _CELLS)
    if direct:
        added: dict[int, np.ndarray] = {}
        for x in found.collect():  # DIRECT_BYTES at most
            part = np.frombuffer(x.cells).reshape(3, len(read[x.m]), -1, 256)
            added[x.m] = added[x.m] + part if x.m in added else part
        out = {}
        for m, nodes in wanted.items():
            lay, at = lays[fold_at[m]], {v: i for i, v in enumerate(read[m])}
            own = added.get(m, np.zeros((3, len(read[m]), len(lay.wide) + len(lay.packs), 256)))
            for v in read[m]:
                sums[m, v] = own[:, at[v]]
            for large, (small, parent) in rest[m].items():
                sums[m, large] = sums[m, parent] - sums[m, small]
            for parent in {parent_of[m].get(v) for v in nodes}:
                sums.pop((m, parent), None)
            columns = tree_columns(p, tasks[m].spec, r)
            on = [k for k, c in enumerate(lay.wide) if c in columns]
            some = np.stack([sums[m, v] for v in nodes], axis=1)[:, :, [*on, *range(len(lay.wide), len(lay.wide) + len(lay.packs))]]
            out |= {(m, v): s for v, s in zip(nodes, packed_splits(some, [lay.wide[k] for k in on], lay, columns, tasks[m].spec), strict=True)}
        return out
    tasks_at_most = state.sparkSession.sparkContext.defaultParallelism
    found = found.repartition(max(1, min(sum(map(len, wanted.values())), tasks_at_most)), "m", "v").sortWithinPartitions("m", "v").mapInArrow(pick, _SPLIT).collect()  # one row an open node
    return {(x.m, x.v): ((x.g, x.h, int(x.n)), (x.gain, x.column, x.cut, x.gl, x.hl, int(x.nl))) for x in found}


def _merged(parts: list) -> list[np.ndarray]:
    if len(parts) == 1:
        return list(parts[0])
    cell, of = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return [cell, *(np.bincount(of, np.concatenate([x[k] for x in parts]), len(cell)) for k in (1, 2, 3))]


def over_rows(rows: DataFrame, tasks: Sequence[Task], bins: dict) -> list[Ensemble]:
    """All models, trained together: a scan of the rows answers the open nodes of every one."""
    tasks, folds = list(tasks), list(bins)
    p, fold_at = len(next(iter(bins.values())).edges), [folds.index(t.fold) for t in tasks]
    counts = {r.fold: (r.n, r.pos) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}  # one row a fold
    models, weights = [], []
    for t in tasks:
        n, pos = (sum(c[k] for f, c in counts.items() if f != t.fold or t.fold is None) for k in (0, 1))
        models.append(Ensemble(t.spec, _base(pos, n, t.spec), bins[t.fold]))
        weights.append((n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1))) if t.spec.balanced else (1.0, 1.0))
    state = _state(rows, tasks, models, folds, p, sum(c[0] for c in counts.values())).checkpoint().persist()  # every scan reads it
    parts = state.rdd.getNumPartitions()
    lays = [layout(np.array([len(e) + 1 for e in bins[f].edges], int)) for f in folds]
    pending: list[list[Tree]] = [[] for _ in tasks]
    for r in range(max(t.spec.rounds for t in tasks)):
        now = {m: Tree() for m, t in enumerate(tasks) if r < t.spec.rounds}
        growing = {m: grower(tree, tasks[m].spec) for m, tree in now.items()}
        wanted, sums = {m: next(g) for m, g in growing.items()}, {}
        while wanted:
            found = _scan(state, parts, tasks, fold_at, p, lays, weights, pending, [now.get(m) for m in range(len(tasks))], wanted, r, sums)
            asked, wanted = wanted, {}
            for m, nodes in asked.items():
                try:
                    none = ((0.0, 0.0, 0), NONE)
                    wanted[m] = growing[m].send({v: found.get((m, v), none) for v in nodes})
                except StopIteration:
                    pass
        for m, tree in now.items():
            models[m].trees.append(tree)
            if tasks[m].spec.kind == "boost":
                pending[m].append(tree)
        if r % KEEP == KEEP - 1 and any(pending):
            old, state = state, _kept(state, tasks, fold_at, p, len(folds), pending).checkpoint().persist()
            old.unpersist()
            pending = [[] for _ in tasks]
    state.unpersist()
    return models


def _kept(state: DataFrame, tasks: list[Task], fold_at: list[int], p: int, folds: int, pending: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, fold, codes, margins in _unpacked(batches, folds, p, len(tasks)):
            new = margins.copy()
            for m, trees in enumerate(pending):
                new[m] += Ensemble(tasks[m].spec, 0.0, None).margin(codes[fold_at[m]].T, trees)
            yield _packed([ids, y, fold, codes, new])
    return state.mapInArrow(run, state.schema)


def scored(rows: DataFrame, tasks: Sequence[Task], models: Sequence[Ensemble]) -> DataFrame:
    """(model, fold, k, label, p) of each task's held-out rows under trained models (trees x nodes: a bounded broadcast)."""
    shared = rows.sparkSession.sparkContext.broadcast(list(zip(tasks, models, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, fold = b.column(2).to_numpy(), b.column(3).to_numpy()
            for task, model in shared.value:
                on = np.flatnonzero(fold == task.fold) if task.fold is not None else np.arange(len(y))
                if len(on):
                    x = _matrix(b.column(4), len(model.bins.edges))[on]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([task.name] * len(on)), pa.array(np.full(len(on), -1 if task.fold is None else task.fold, np.int32)), b.column(1).take(pa.array(on)),
                        pa.array(y[on].astype(np.int32)), pa.array(model.probability(model.bins.codes(x)))], names=_SCORES.names)
    return rows.mapInArrow(run, _SCORES)


def cross_scores(df: DataFrame, specs: dict[str, TreeSpec], columns: Sequence[str], label: str, key: str, fold: str, k: int, local: bool | None = None) -> DataFrame:
    """Out-of-fold (model, fold, k, label, p) of every spec and fold; ``k`` is the key as a string. Missing values count as the training rows' median.

    ``local`` forces a way of training; by itself the row count decides (``fits_tasks``).
    """
    folds = list(range(k))
    bins = fit_bins(df, columns, fold, folds)
    tasks = [Task(name, f, spec) for name, spec in specs.items() for f in folds]
    rows = _frame(df, columns, label, key, fold)
    cells = df.count() * max(1, len(columns)) if local is None else 0
    if cells <= LOCAL_CELLS if local is None else local:
        return in_tasks(rows, tasks, bins).checkpoint()
    if local is None and cells <= TASK_CELLS:
        return by_reading(rows, tasks, bins).checkpoint()
    return scored(rows, tasks, over_rows(rows, tasks, bins))


def fit(df: DataFrame, spec: TreeSpec, columns: Sequence[str], label: str, key: str, local: bool | None = None) -> Ensemble:
    """One model on all rows of ``df``."""
    bins = fit_bins(df, columns, None, [None])
    rows = _frame(df, columns, label, key, None)
    if not (fits_tasks(df, columns) if local is None else local):
        return over_rows(rows, [Task("model", None, spec)], bins)[0]
    data = _collected(rows, bins)
    return train(data.under(None, np.arange(len(data.y))), data.y, data.ids, bins[None], spec)


def predictions(df: DataFrame, model: Ensemble, columns: Sequence[str], label: str, key: str) -> DataFrame:
    """(key, label, p) of every row."""
    out = scored(_frame(df, columns, label, key, None), [Task("model", None, replace(model.spec))], [model])
    return out.select(F.col("k").cast(df.schema[key].dataType).alias(key), "label", "p")
