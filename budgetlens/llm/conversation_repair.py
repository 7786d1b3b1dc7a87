"""Conversation repair: the cheapest edits that make roles alternate, and of these the least audit, by prefix-doubling ranks.

A conversation is right if its roles' initials spell ``(s?(ua)+)?``. Keep a row (0), Rerole it to user or assistant (2), Delete it (3), or
Insert an empty turn of either role anywhere (2). Blank rows and rows that repeat an earlier one must go; a row kept or reroled although its text breaks off costs 1
more. Nodes are (row, state), states start, S, U, A:
  1. costs  : a row is a 4 x 4 matrix of the cheapest ways from state to state, inserts before it included. Products of 1, 2, 4, ... rows
              under (min, +) give every suffix's costs in log(rows) steps, for all conversations of a batch at once;
  2. ranking: arcs that lie on a cheapest path stay. Every node's least audits of 1, 2, 4, ... letters are ranked, each length by the pair of ranks of
              its halves; pointers to the nodes behind double along;
  3. path   : of a node's arcs the one with the least letter, then rank, is taken; the pointers list a path's nodes all at once. (A letter
              fixes the state it leads to, so an audit fixes its repair.)

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation lies in one task or in neighbouring ones. Those
that lie inside a task are repaired there and then. Blocks of the others (at most two a task, or cut at BLOCK_ROWS or BLOCK_BYTES) go
on as packed rows: repeats are found by the texts' hashes, each block gives its matrix, a scan over a conversation's matrices gives the costs
behind each block, the blocks give where each entry state leads, and a second scan the state in which each is entered. So no task holds a
conversation, however long: what meets in one place is one matrix a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import IS_WS, pack, shuffle_partitions, span_hashes, stored, unpack

BLOCK_ROWS = 1 << 15
BLOCK_BYTES = 8 << 20
_START, _S, _U, _A = range(4)
_FAR = 1 << 40
# fixed values: costs of the edits, and of keeping a text that breaks off
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # in the order of their codes
_D, _I, _K, _R = range(1, 5)
AFTER = np.array([_U, _U, _A, _U])  # the state behind an inserted or reroled turn
KEPT = np.array([[_S, -1, -1, -1], [_U, _U, -1, _U], [-1, -1, _A, -1], [-1, -1, -1, -1]])  # behind a kept s, u, a or other row, by state
ENDS = np.array([0, 2 * INSERT, INSERT, 0])  # costs from each state to a right end
_SECOND = 0xC2B2AE3D27D4EB4F | 1
MUST_GO = 8  # kind of a row: initial (s, u, a, other) + 4 if it breaks off, or this


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of (n, 4, 4) by (n, 4, 4) or (n, 4) under (min, +)."""
    if b.ndim == 2:
        return (a + b[:, None, :]).min(axis=2)
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), _FAR)


def _matrices() -> np.ndarray:
    """The cheapest ways past a row of each kind."""
    insert = np.full((4, 4), _FAR)
    for s in range(4):
        insert[s, s] = 0
        insert[s, AFTER[s]] = INSERT
        insert[s, AFTER[AFTER[s]]] = min(insert[s, AFTER[AFTER[s]]], 2 * INSERT)
    out = np.full((9, 4, 4), _FAR)
    for kind in range(9):
        for s in range(4):
            out[kind, s, s] = DELETE
            if kind != MUST_GO:
                extra = BROKEN * (kind >= 4)
                out[kind, s, AFTER[s]] = min(out[kind, s, AFTER[s]], REROLE + extra)
                if KEPT[kind % 4, s] >= 0:
                    out[kind, s, KEPT[kind % 4, s]] = min(out[kind, s, KEPT[kind % 4, s]], KEEP + extra)
    return _plus(np.broadcast_to(insert, (9, 4, 4)), out)


PAST = _matrices()


def suffix_products(kind: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For every row the product of the matrices from it to the last row of its conversation (``end``: one past that)."""
    out, at = PAST[kind], np.arange(len(kind))
    step = 1
    while step < (end - at).max(initial=0):
        more = at[at + step < end]
        after = out.copy()
        after[more] = _plus(out[more], out[more + step])
        out, step = after, step * 2
    return out


class Paths:
    """The least cheapest path from every node of some conversations (or blocks): rows first[c]..first[c+1], costs ``behind`` each."""

    def __init__(self, kind: np.ndarray, first: np.ndarray, behind: np.ndarray, final: np.ndarray):
        rows, n = np.diff(first), len(first) - 1
        conv = np.repeat(np.arange(n), rows)
        products = suffix_products(kind, first[conv + 1])
        self.column = first[:-1] + np.arange(n)  # of a conversation's first node column; it has one more than rows
        row_column = np.arange(len(kind)) + conv
        cost = np.empty((len(kind) + n, 4), np.int64)
        last = self.column + rows
        cost[last] = behind
        cost[row_column] = _plus(products, behind[conv])
        self.cost = cost
        self.row = np.full(len(cost), -1)
        self.row[row_column] = np.arange(len(kind))
        self._rank(*self._arcs(kind, row_column, last[final]), len(cost) * 4)

    def _arcs(self, kind: np.ndarray, column: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, letter, node behind) of all arcs on cheapest paths."""
        cost, found = self.cost, []

        def add(c, s, letter, c2, s2, price):
            on = cost[c, s] == price + cost[c2, s2]
            found.append((c[on] * 4 + s, np.full(on.sum(), letter), c2[on] * 4 + (s2 if np.isscalar(s2) else s2[on])))

        broken = BROKEN * ((kind >= 4) & (kind < MUST_GO))
        for s in range(4):
            both = np.concatenate((column, final))
            add(both, s, _I, both, int(AFTER[s]), INSERT)
            add(column, s, _D, column + 1, s, DELETE)
            free = kind != MUST_GO
            add(column[free], s, _R, column[free] + 1, int(AFTER[s]), REROLE + broken[free])
            to = np.where(free, KEPT[kind % 4, s], -1)
            on = to >= 0
            add(column[on], s, _K, column[on] + 1, to[on], KEEP + broken[on])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _rank(self, node: np.ndarray, letter: np.ndarray, behind: np.ndarray, n: int) -> None:
        def least(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((rank[behind], letter, node))
            head = order[np.concatenate(([True], np.diff(node[order]) != 0))] if len(order) else order
            to, by = np.arange(n), np.zeros(n, np.int64)
            to[node[head]], by[node[head]] = behind[head], letter[head]
            return to, by

        to, rank = least(np.zeros(n, np.int64))  # a node without arcs ends its audit: it points to itself, letter 0
        while (to != np.arange(n)).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[to], return_inverse=True)[1]
            further = to[to]
            if (further == to).all():
                break
            to = further
        to, self.letter = least(rank)
        self.jumps, self.steps = [to], [(self.letter > 0).astype(np.int64)]
        while (self.jumps[-1] != (further := self.jumps[-1][self.jumps[-1]])).any():
            self.steps.append(self.steps[-1] + self.steps[-1][self.jumps[-1]])
            self.jumps.append(further)

    def exits(self) -> np.ndarray:
        """State at the end of each conversation's path, by entry state."""
        return self.jumps[-1][self.column[:, None] * 4 + np.arange(4)] % 4

    def nodes(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All nodes but the last of each conversation's path from its entry state, and how many each has."""
        begin = self.column * 4 + entry
        count = self.steps[-1][begin] if len(begin) else np.zeros(0, np.int64)
        node = np.repeat(begin, count)
        step = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
        for k, jump in enumerate(self.jumps):
            on = (step >> k) & 1 > 0
            node[on] = jump[node[on]]
        return node, count


# --------------------------------------------------------------------------- rows of a task
class _Block:
    """Sorted rows as numpy views; ``first`` holds each conversation's first row (and the row count)."""

    def __init__(self, rows: pa.Table):
        """Columns: conv, turn, role, text, present. Rows that are not present only name their conversation."""
        conv = rows.column("conv").combine_chunks()
        key, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        head = np.concatenate(([True], (np.diff(key) != 0) | (null[1:] != null[:-1]))) if len(key) else np.zeros(0, bool)
        self.conv = conv.take(pa.array(np.flatnonzero(head)))
        of = np.cumsum(head) - 1
        here = rows.column("present").combine_chunks().to_numpy(zero_copy_only=False)
        self.first = np.searchsorted(of[here], np.arange(len(self.conv) + 1))
        rows = rows.filter(pa.array(here))
        turn = rows.column("turn").combine_chunks()
        self.turn, self.no_turn = turn.fill_null(0).to_numpy(), turn.is_null().to_numpy(zero_copy_only=False)
        (self.role, self.role_at), (self.text, self.text_at) = (self._bytes(rows.column(x)) for x in ("role", "text"))
        self._derive()

    @staticmethod
    def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        array = column.cast(pa.large_string()).combine_chunks()
        data = array.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        return raw[at[0] : at[-1]], at - at[0]

    def packed(self) -> bytes:
        return pack(self.turn, self.no_turn, self.role, self.role_at, self.text, self.text_at)

    @classmethod
    def unpacked(cls, conv: list, blobs: list[bytes]) -> _Block:
        """Blocks one after the other; each counts as a conversation of its own."""
        self = cls.__new__(cls)
        parts = [unpack(b) for b in blobs]
        self.conv = pa.array(conv, pa.int64())
        self.first = np.cumsum([0, *(len(p[0]) for p in parts)])
        self.turn, self.no_turn, self.role, _, self.text, _ = (np.concatenate([p[k] for p in parts]) for k in range(6))
        self.role_at, self.text_at = (np.cumsum(np.concatenate([[0], *(np.diff(p[k]) for p in parts)])) for k in (3, 5))
        self._derive()
        return self

    def _derive(self) -> None:
        rows = len(self.turn)
        self.of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        ink = np.flatnonzero(~IS_WS[self.text])
        last = np.searchsorted(ink, self.text_at[1:]) - 1
        last = ink[np.maximum(last, 0)] if len(ink) else np.full(rows, -1)
        self.blank = (last < self.text_at[:-1]) | (last >= self.text_at[1:])
        ends = np.isin(self.text[np.minimum(last, len(self.text) - 1)], np.frombuffer(b".!?", np.uint8)) if len(self.text) else np.zeros(rows, bool)
        self.broken = ~self.blank & ~ends
        empty = np.diff(self.role_at) == 0
        lead = np.where(empty, 0, self.role[np.minimum(self.role_at[:-1], max(len(self.role) - 1, 0))]) if len(self.role) else np.zeros(rows, np.uint8)
        self.initial = np.select([lead == ord("s"), lead == ord("u"), lead == ord("a")], [0, 1, 2], 3)
        cut = [span_hashes(self.role, self.role_at[:-1], self.role_at[1:]) * np.uint64(0x9FB21C651E98DF25), span_hashes(self.text, self.text_at[:-1], self.text_at[1:])]
        self.hash = cut[0] + cut[1]
        self.hash2 = span_hashes(self.text, self.text_at[:-1], self.text_at[1:], base=_SECOND) ^ cut[0]
        order = np.lexsort((np.arange(rows), self.hash2, self.hash, self.of))
        same = (np.diff(self.of[order]) == 0) & (np.diff(self.hash[order]) == 0) & (np.diff(self.hash2[order]) == 0)
        self.again = np.zeros(rows, bool)
        self.again[order[1:][same]] = True

    def kinds(self) -> np.ndarray:
        self.repeat = self.again & ~self.blank
        return np.where(self.blank | self.repeat, MUST_GO, self.initial + 4 * self.broken)

    def illegal(self) -> np.ndarray:
        """Rows whose initial may not follow the row before in the same conversation."""
        a, b = self.initial[:-1], self.initial[1:]
        right = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
        return np.concatenate(([False], ~right & (self.of[1:] == self.of[:-1]))) if len(self.initial) else np.zeros(0, bool)

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def turns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(smallest, largest, distinct) turn of each conversation; without turns 0, -1, 0. Rows are sorted, nulls first."""
        known = ~self.no_turn
        new = known.copy()
        new[1:] &= ~(known[:-1] & (self.turn[1:] == self.turn[:-1]) & (self.of[1:] == self.of[:-1]))
        has = self.sums(known) > 0
        low = self.first[:-1] + self.sums(self.no_turn)
        pad = np.append(self.turn, 0)
        return np.where(has, pad[np.minimum(low, len(self.turn))], 0), np.where(has, pad[self.first[1:] - 1], -1), self.sums(new)


_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PIECE = T.StructType([
    T.StructField("conv", T.LongType()), T.StructField("block", T.LongType()), *(T.StructField(x, T.LongType()) for x in _NUMBERS),
    T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(_TURN)), T.StructField("blob", T.BinaryType())])
_ARROW_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_ARROW_PIECE = pa.schema([("conv", pa.int64()), ("block", pa.int64()), *((x, pa.int64()) for x in _NUMBERS), ("audit", pa.string()), ("repaired", pa.list_(_ARROW_TURN)), ("blob", pa.binary())])


def _pieces(b: _Block, paths: Paths, entry: np.ndarray, block: np.ndarray, numbers: dict) -> pa.RecordBatch:
    """A row for each conversation (or block) of ``b``, repaired along its path."""
    node, count = paths.nodes(entry)
    letter, row, state = paths.letter[node], paths.row[node // 4], node % 4
    audit, cut = LETTERS[letter].tobytes().decode(), np.concatenate(([0], np.cumsum(count))).tolist()
    stays = letter != _D
    made = {_U: "user", _A: "assistant"}
    roles = [b.role[b.role_at[r] : b.role_at[r + 1]].tobytes().decode("utf-8", "replace") if k == _K else made[int(AFTER[s])]
             for k, r, s in zip(letter[stays].tolist(), row[stays].tolist(), state[stays].tolist(), strict=True)]
    texts = [b"" if k == _I else b.text[b.text_at[r] : b.text_at[r + 1]].tobytes() for k, r in zip(letter[stays].tolist(), row[stays].tolist(), strict=True)]
    kept = np.concatenate(([0], np.cumsum(stays)))[cut]
    turns = pa.StructArray.from_arrays([pa.array(roles, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], fields=list(_ARROW_TURN))
    return pa.RecordBatch.from_arrays([
        b.conv, pa.array(block), *(pa.array(np.asarray(numbers[x], np.int64)) for x in _NUMBERS), pa.array([audit[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
        pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), turns), pa.nulls(len(b.conv), pa.binary())], schema=_ARROW_PIECE)


def _solved(rows: pa.Table) -> pa.RecordBatch:
    b = _Block(rows)
    n = len(b.conv)
    kind = b.kinds()
    paths = Paths(kind, b.first, np.broadcast_to(ENDS, (n, 4)), np.ones(n, bool))
    low, high, distinct = b.turns()
    numbers = {"gaps": np.where(distinct > 0, high - low + 1 - distinct, 0), "blank": b.sums(b.blank), "duplicate": b.sums(b.repeat),
               "truncated": b.sums(b.broken & ~b.repeat), "illegal": b.sums(b.illegal()), "cost": paths.cost[paths.column, _START]}
    return _pieces(b, paths, np.zeros(n, np.int64), np.zeros(n, np.int64), numbers)


def _deal(batches: Iterator[pa.RecordBatch], block_rows: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations that lie inside this task; packed blocks of the first and the last one, and of long ones."""
    task, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    held, held_rows, held_bytes, first = [], 0, 0, True

    def open_block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal made
        b = _Block(rows)
        made += 1
        row = {"conv": b.conv[0].as_py(), "block": (task << 32) + made, "blob": b.packed()}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW_PIECE)

    def cut(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        """What is done, as batches; then the rows that must wait."""
        nonlocal first
        conv = rows.column("conv").combine_chunks()
        key, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        border = np.flatnonzero((np.diff(key) != 0) | (null[1:] != null[:-1])) + 1
        begin, end = 0, rows.num_rows
        if first and len(border):
            yield open_block(rows.slice(0, int(border[0])))
            first, begin = False, int(border[0])
        if len(border) and (wait := int(border[-1])) > begin:
            yield _solved(rows.slice(begin, wait - begin))
            begin = wait
        rest = rows.slice(begin, end - begin)
        if last or rest.num_rows >= block_rows or rest.nbytes >= block_bytes:
            yield open_block(rest)  # and what follows of this conversation is a block that starts anew
            first = True
            rest = rest.slice(0, 0)
        yield rest

    for batch in batches:
        for at in range(0, batch.num_rows, block_rows):
            part = batch.slice(at, block_rows)
            held, held_rows, held_bytes = [*held, part], held_rows + part.num_rows, held_bytes + part.nbytes
            if held_rows >= block_rows or held_bytes >= block_bytes:
                *done, rest = cut(pa.Table.from_batches(held), False)
                yield from done
                held, held_rows, held_bytes = rest.to_batches(), rest.num_rows, rest.nbytes
    if held_rows:
        yield from list(cut(pa.Table.from_batches(held), True))[:-1]


# --------------------------------------------------------------------------- conversations over several tasks
def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, dict]]:
    """Some open blocks at once, with their other columns; ``seen`` names hashes that an earlier block holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8):
            rows = batch.slice(at, 8).to_pydict()
            b = _Block.unpacked(rows["conv"], rows["blob"])
            for c, seen in enumerate(rows.get("seen", [])):
                if seen:
                    a, z = b.first[c], b.first[c + 1]
                    known = np.frombuffer(seen, np.int64).reshape(-1, 2).view(np.uint64)
                    mine = np.isin(b.hash[a:z], known[:, 0]) & np.isin(b.hash2[a:z], known[:, 1])
                    b.again[a:z] |= mine
            yield b, rows


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, rows in _opened(batches):
        new = ~b.blank & ~b.again
        of = b.of[new]
        yield pa.RecordBatch.from_arrays([
            b.conv.take(pa.array(of)), pa.array(np.asarray(rows["block"], np.int64)[of]), pa.array(b.hash[new].view(np.int64)), pa.array(b.hash2[new].view(np.int64))], names=["conv", "block", "h1", "h2"])


_FACTS = T.StructType([T.StructField(x, T.LongType()) for x in ("conv", "block", "rows", "head", "tail", "low", "high", "distinct")] + [T.StructField("matrix", T.BinaryType())])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's matrix, its first and last initial, and its turns."""
    for b, rows in _opened(batches):
        kind, n = b.kinds(), len(b.conv)
        products = suffix_products(kind, b.first[b.of + 1])
        low, high, distinct = b.turns()
        size = np.diff(b.first)
        none = np.where(np.eye(4, dtype=bool), 0, _FAR)
        at = np.minimum(b.first[:-1], max(len(kind) - 1, 0))
        whole = [products[at[c]] if size[c] else none for c in range(n)]
        pad = np.append(b.initial, 3)
        numbers = [size, pad[at], pad[np.maximum(b.first[1:] - 1, 0)], low, high, distinct]
        yield pa.RecordBatch.from_arrays([b.conv, pa.array(rows["block"], pa.int64()), *(pa.array(np.asarray(x, np.int64)) for x in numbers), pa.array([m.tobytes() for m in whole], pa.binary())], names=[f.name for f in _FACTS])


_BEHIND = T.StructType([T.StructField(x, T.LongType()) for x in ("conv", "block", "gaps", "illegal_before", "cost", "final")] + [T.StructField("behind", T.BinaryType())])


def _scan(facts: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each block of one conversation; its gaps, border faults and total cost go to its first block."""
    facts = facts.sort_values("block").reset_index(drop=True)
    n, behind, costs = len(facts), [], np.array(ENDS, np.int64)
    for m in reversed(facts["matrix"].tolist()):
        behind.append(costs.tobytes())
        costs = (np.frombuffer(m, np.int64).reshape(4, 4) + costs[None, :]).min(axis=1)
    some = facts[facts["distinct"] > 0]
    joined = int((some["high"].to_numpy()[:-1] == some["low"].to_numpy()[1:]).sum())
    gaps = int(some["high"].max() - some["low"].min() + 1 - some["distinct"].sum() + joined) if len(some) else 0
    held = facts[facts["rows"] > 0]
    pairs = list(zip(held["tail"].tolist()[:-1], held["head"].tolist()[1:], strict=True))
    illegal = sum(p not in {(0, 1), (1, 2), (2, 1)} for p in pairs)
    lead = np.arange(n) == 0
    return pd.DataFrame({"conv": facts["conv"], "block": facts["block"], "gaps": gaps * lead, "illegal_before": illegal * lead, "cost": costs[_START] * lead, "final": (np.arange(n) == n - 1) * 1, "behind": behind[::-1]})


_EXITS = T.StructType([T.StructField(x, T.LongType()) for x in ("conv", "block", "e0", "e1", "e2", "e3")])
_ENTRY = T.StructType([T.StructField(x, T.LongType()) for x in ("conv", "block", "entry")])


def _block_paths(b: _Block, rows: dict) -> Paths:
    behind = np.array([np.frombuffer(x, np.int64) for x in rows["behind"]]).reshape(-1, 4)
    return Paths(b.kinds(), b.first, behind, np.array(rows["final"]) > 0)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, rows in _opened(batches):
        to = _block_paths(b, rows).exits()
        yield pa.RecordBatch.from_arrays([b.conv, pa.array(rows["block"], pa.int64()), *(pa.array(to[:, s]) for s in range(4))], names=[f.name for f in _EXITS])


def _enter(exits: pd.DataFrame) -> pd.DataFrame:
    exits = exits.sort_values("block").reset_index(drop=True)
    state, entry = _START, []
    for to in exits[["e0", "e1", "e2", "e3"]].itertuples(index=False):
        entry.append(state)
        state = to[state]
    return pd.DataFrame({"conv": exits["conv"], "block": exits["block"], "entry": entry})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, rows in _opened(batches):
        paths = _block_paths(b, rows)
        numbers = {"gaps": rows["gaps"], "blank": b.sums(b.blank), "duplicate": b.sums(b.repeat), "truncated": b.sums(b.broken & ~b.repeat),
                   "illegal": b.sums(b.illegal()) + np.array(rows["illegal_before"]), "cost": rows["cost"]}
        yield _pieces(b, paths, np.array(rows["entry"]), np.array(rows["block"]), numbers)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None,
           block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv, block, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): every conversation, in one piece or several.

    Most conversations give one piece (block 0). One that several tasks share gives a piece a block, to be read by ascending
    ``block``: audits and ``repaired`` turns (role, text) follow each other, the numbers add up. ``gaps`` counts the turn numbers
    missing between the smallest and the largest; ``blank``, ``duplicate`` and ``truncated`` each row's first fault; ``illegal``
    neighbours that may not follow each other; ``cost`` the cheapest repair and ``audit`` its edits' initials, the least of all cheapest.

    Rows go by turn (null first), then role, then a hash of the text; equal rows are repeats. Null roles and texts read as one space; ids and turns are
    integers and may be null (one conversation of null id) or repeated. Rows whose ``present_col`` is not true count as absent but name their
    conversation, which then has zeros and an empty audit if nothing else is left. Other columns (any names) are not read.
    """
    spark = rows.sparkSession
    present = F.lit(True) if present_col is None else F.coalesce(F.col(present_col), F.lit(False))
    src = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), present.alias("present"))
    order = ["conv", "turn", "role", "tie", "row"]  # equal rows may lie in several tasks: which of them is which doesn't matter
    src = src.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = src.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "present")
    pieces = stored(dealt.mapInArrow(lambda batches: _deal(batches, block_rows, block_bytes), _PIECE), "repair-pieces")
    opened = pieces.where(F.col("blob").isNotNull()).select("conv", "block", "blob")

    found = stored(opened.mapInArrow(_hashes, T.StructType([T.StructField(x, T.LongType()) for x in ("conv", "block", "h1", "h2")])), "repair-hashes")
    firsts = found.groupBy("conv", "h1", "h2").agg(F.min("block").alias("b0"), F.count("*").alias("n")).where("n > 1").toDF("c0", "k1", "k2", "b0", "n")
    later = found.join(firsts, F.col("conv").eqNullSafe(F.col("c0")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("block") > F.col("b0")))
    later = later.groupBy("conv", "block").agg(F.collect_list(F.struct("h1", "h2")).alias("hs"))  # a block's texts at most
    later = later.mapInArrow(_seen, T.StructType([T.StructField("conv", T.LongType()), T.StructField("block", T.LongType()), T.StructField("seen", T.BinaryType())]))

    def beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("conv", "conv2").withColumnRenamed("block", "block2")
        return left.join(right, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("block") == F.col("block2")), how).drop("conv2", "block2")

    known = stored(beside(opened, later, "left"), "repair-open")
    behind = stored(known.mapInArrow(_facts, _FACTS).groupBy("conv").applyInPandas(_scan, _BEHIND), "repair-behind")
    asked = beside(known, behind)
    entry = asked.mapInArrow(_exits, _EXITS).groupBy("conv").applyInPandas(_enter, _ENTRY)
    finished = beside(asked, entry).mapInArrow(_finish, _PIECE)
    return pieces.where(F.col("blob").isNull()).unionByName(finished).drop("blob")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [np.array([(h["h1"], h["h2"]) for h in hs], np.int64).tobytes() for hs in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["conv", "block", "seen"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order; SHA-256 is fed piece by piece."""
    names = ["conv", *_NUMBERS, "audit", "repaired_sha256"]
    now, held, out = None, {}, []
    digest, audit, any_turn = None, [], False

    def close() -> None:
        if now is not None:
            out.append({**held, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})

    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["conv"],):
                close()
                now, held, digest, audit, any_turn = (row["conv"],), {"conv": row["conv"], **dict.fromkeys(_NUMBERS, 0)}, hashlib.sha256(), [], False
            for x in _NUMBERS:
                held[x] += row[x]
            audit.append(row["audit"])
            for turn in row["repaired"]:
                digest.update((("\n" if any_turn else "") + turn["role"] + ":" + turn["text"]).encode())
                any_turn = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(x, pa.int64()) for x in names[:-2]] + [(x, pa.string()) for x in names[-2:]]))
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(x, pa.int64()) for x in names[:-2]] + [(x, pa.string()) for x in names[-2:]]))


def conversations(pieces: DataFrame) -> DataFrame:
    """One row a conversation of ``repair``: its numbers, its whole audit, and the SHA-256 of its turns as ``role:text`` lines.

    Pieces in one block are finished where they are. Those of one conversation follow each other in one task, which holds one of them and the audit: SHA-256
    takes a text in order, so this step can't be split.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where(F.col("block") == 0).select("conv", *_NUMBERS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    out = T.StructType([T.StructField(x, T.LongType()) for x in ("conv", *_NUMBERS)] + [T.StructField(x, T.StringType()) for x in ("audit", "repaired_sha256")])
    shared = pieces.where(F.col("block") > 0).repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_digest, out)
    return whole.unionByName(shared)
