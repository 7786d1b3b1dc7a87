"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task pre-splits its texts (vectorised over code-point classes), keeps each distinct piece once, and lays all pieces
out as one linked symbol array. An index maps every mergeable pair's rank to all positions where the pair occurs. Active
ranks are applied in ascending order: one rank's merges take place at all of its positions at once (from the left where they
overlap), and the pairs that appear beside them join the lists of their ranks. A merged symbol can only take part in later
ranks, so this yields what merging the best pair of each piece again and again yields.

The vocabulary file is a parameter; its bytes are broadcast (some MB, whatever the input's size). Pieces already encoded in a
task are remembered, up to CACHE of them. Nothing is shuffled, and memory is bounded by GROUP_BYTES of text or one text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import span_hashes, text_slices

GROUP_BYTES = 1 << 20  # a group's arrays take some dozen times its text
BATCH_BYTES = 4 << 20  # of ids and texts that go back at once
CACHE = 1_000_000
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)

# fixed values: letters and numbers that Unicode 16 added to 15.1, and the white space of the pre-split pattern
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
ADDED_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
WHITE_SPACE = [(9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
SUFFIX_1, SUFFIX_2 = b"stmd", (b"re", b"ve", b"ll")  # after an apostrophe

_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point, made once a process."""
    if not _CLASSES:
        kind = {"L": _LETTER, "N": _NUMBER}
        out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for ranges, k in ((ADDED_LETTERS, _LETTER), (ADDED_NUMBERS, _NUMBER), (WHITE_SPACE, _SPACE)):
            for a, b in ranges:
                out[a : b + 1] = k
        _CLASSES.append(out)
    return _CLASSES[0]


def split_pieces(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """First byte of each piece of UTF-8 text; no piece crosses one of the ascending byte positions ``cuts``.

    Pieces are contractions, runs of letters, of numbers or of other signs (each with the one space before it), and white
    space, whose last character is left to what follows it.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    lead, n = raw[chars], len(chars)
    table = _classes()
    cls = table[:128][np.minimum(lead, 127)]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        p, more = chars[wide], np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int64)
        b0, b1, b2, b3 = (more[p + k] for k in range(4))
        two, three = ((b0 & 0x1F) << 6) | (b1 & 0x3F), ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
        four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
        cls[wide] = table[np.minimum(np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four)), sys.maxunicode)]
    border = np.zeros(n + 1, dtype=bool)
    border[np.searchsorted(chars, cuts)] = True
    border[[0, n]] = True
    start = border.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    run = np.flatnonzero(start)  # the last one is n
    a, b, kind = run[:-1], run[1:], cls[run[:-1]]
    gap = (kind == _SPACE) & ~border[b]
    last_blank = lead[b - 1] == 32
    start[(b - 1)[gap]] = True
    start[b[gap & last_blank]] = False  # the space belongs to the run behind it
    quote = (kind == _OTHER) & (b - a == 1) & (lead[a] == 39) & start[a] & ~border[b] & (cls[np.minimum(b, n - 1)] == _LETTER)
    for at, first in zip(a[quote].tolist(), b[quote].tolist(), strict=True):
        pair = lead[first : first + 2].tobytes()
        if pair[:1] in [SUFFIX_1[k : k + 1] for k in range(len(SUFFIX_1))]:
            size = 1
        elif pair in SUFFIX_2 and not border[first + 1] and cls[first + 1] == _LETTER:
            size = 2
        else:
            continue
        start[first] = False
        start[first + size] |= not (first + size < n and start[first + size]) and cls[min(first + size, n - 1)] == _LETTER
    start[n] = False
    return chars[np.flatnonzero(start[:n])]


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself, or the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file (JSON of the tokenizers library)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE file that starts words without a prefix space and always merges")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        self.left, self.right, self.made = left, right, np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        key = (left << 32) | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 for pairs that never merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


class PairIndex:
    """Positions of every mergeable pair, by rank, over pieces laid out one after the other."""

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray, first: np.ndarray):
        self.v, n = vocabulary, len(symbols)
        self.symbol = symbols.copy()
        self.next = np.arange(1, n + 1)
        self.before = np.arange(-1, n - 1)
        self.next[np.append(first[1:], n) - 1] = -1
        self.before[first] = -1
        self.alive = np.ones(n, dtype=bool)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0))

    def _add(self, at: np.ndarray) -> None:
        rank = self.v.rank(self.symbol[at], self.symbol[self.next[at]])
        keep = rank >= 0
        at, rank = at[keep], rank[keep]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        border = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate(([0], border))].tolist(), np.split(at, border), strict=True):
            if r in self.lists:
                self.lists[r].append(part)
            else:
                self.lists[r] = [part]
                heapq.heappush(self.active, r)

    def merge_all(self) -> None:
        while self.active:
            r = heapq.heappop(self.active)
            parts = self.lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.v.left[r], self.v.right[r]
            at = at[self.alive[at] & (self.symbol[at] == a) & (self.next[at] >= 0)]
            at = at[self.symbol[self.next[at]] == b]
            if a == b and len(at) > 1:  # a run of one symbol: every other position, from the left
                at = np.sort(at)
                linked = np.concatenate(([False], self.next[at[:-1]] == at[1:]))
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            if not len(at):
                continue
            gone = self.next[at]
            after = self.next[gone]
            self.symbol[at], self.next[at], self.alive[gone] = self.v.made[r], after, False
            linked = after >= 0
            self.before[after[linked]] = at[linked]
            left = self.before[at]
            self._add(np.unique(np.concatenate((left[left >= 0], at[linked]))))


def encode_pieces(v: Vocabulary, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces one after the other, and how many each has."""
    size = end - start
    first = np.cumsum(size) - size
    index = PairIndex(v, v.byte_id[raw[np.repeat(start - first, size) + np.arange(size.sum())]], first)
    index.merge_all()
    return index.symbol[index.alive], np.add.reduceat(index.alive.astype(np.int64), first) if len(first) else size


class Encoder:
    """Encodes slices of text; remembers the pieces it has seen in this task."""

    def __init__(self, data: bytes):
        self.v = Vocabulary(data)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        """Encode the (distinct) pieces whose hash is not known yet."""
        spot = np.searchsorted(self.hash, h)
        new = np.flatnonzero((spot == len(self.hash)) | (self.hash[np.minimum(spot, len(self.hash) - 1)] != h) if len(self.hash) else np.ones(len(h), bool))
        if not len(new):
            return
        ids, size = encode_pieces(self.v, raw, start[new], end[new])
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        both = np.concatenate((self.hash, h[new]))
        order = np.argsort(both, kind="stable")
        self.hash, self.at, self.size = both[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def encode(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the text in ``raw``, and the first byte of the piece of each id; ``cuts`` are borders of pieces."""
        start = split_pieces(raw, cuts)
        end = np.append(start[1:], len(raw))
        h, first, piece = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:
            self._forget()
        self._learn(raw, start[first], end[first], h)
        known = np.searchsorted(self.hash, h)
        at, size = self.at[known][piece], self.size[known][piece]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(at - before, size) + np.arange(size.sum())], np.repeat(start, size)

    def encode_slice(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice. Special tokens in a text are one id each, as in the tokenizers library."""
        text = raw.tobytes()
        if self.v.cut is None or not any(t.encode() in text for t in self.v.special):
            ids, where = self.encode(raw, offsets)
            return np.split(ids, np.searchsorted(where, offsets[1:-1]))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            parts = []
            for part in self.v.cut.split(text[a:b].decode("utf-8", "replace")):
                if part in self.v.special:
                    parts.append(np.array([self.v.special[part]], np.int32))
                elif part:
                    own = np.frombuffer(part.encode(), np.uint8)
                    parts.append(self.encode(own, np.array([0, len(own)]))[0])
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Unknown ids are skipped."""
        table, ids = self.v.token_bytes, np.asarray(ids, dtype=np.int64)
        known = (ids >= 0) & (ids < len(table))
        return b"".join(map(table.__getitem__, ids[known].tolist())).decode("utf-8", "replace")


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _output(names: list[str], output: str, ids: pa.Array, each: list[np.ndarray], encoder: Encoder) -> pa.RecordBatch:
    """One batch; Python ids exist for one document at a time."""
    size = np.array([len(x) for x in each], np.int64)
    cols = [ids, pa.array(size)]
    if output == "digests":
        table = encoder.v.decimal
        cols.append(pa.array([hashlib.sha256(",".join(map(table.__getitem__, x.tolist())).encode()).hexdigest() for x in each], pa.string()))
        cols.append(pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in each], pa.string()))
    else:
        flat = np.concatenate(each) if each else np.zeros(0, np.int32)
        cols.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(flat, pa.int32())))
    if output == "round trip":
        cols.append(pa.array([encoder.decode(x) for x in each], pa.string()))
    return pa.RecordBatch.from_arrays(cols, names=names)


def _encode(shared, output: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at, n, raw, off in text_slices(batch.column(1), GROUP_BYTES):
                each = encoder.encode_slice(raw, off)
                weight = np.cumsum([x.nbytes for x in each])
                cut = [0, *(np.flatnonzero(np.diff(weight // BATCH_BYTES)) + 1).tolist(), n]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    yield _output(names, output, batch.column(0).slice(at + a, b - a), each[a:b], encoder)
    return run


_OUTPUTS = {
    "ids": [T.StructField("ids", T.ArrayType(T.IntegerType()))],
    "round trip": [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())],
    "digests": [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())],
}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", output: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ...) of every row with the byte-level BPE file at ``path`` (read by the driver).

    ``output``: ``ids``; ``round trip``, the ids and the text decoded from them; or ``digests``, the SHA-256 of the ids' decimal
    forms joined by commas and that of the decoded text. A null text reads as empty (no ids). Ids may be null or
    repeated; other columns (any names) are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(path))
    src = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("text"))
    out = T.StructType([src.schema["c0"], T.StructField("n_tokens", T.LongType()), *_OUTPUTS[output]])
    return src.mapInArrow(_encode(shared, output, out.names), out).withColumnRenamed("c0", id_col)


def _decode(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode([i for i in ids if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=names)
    return run


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from lists of ids; null lists give null, null and unknown ids are skipped."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_bytes(path))
    src = encoded.select(F.col(id_col).alias("c0"), F.col(ids_col).cast("array<int>").alias("ids"))
    out = T.StructType([src.schema["c0"], T.StructField("text", T.StringType())])
    return src.mapInArrow(_decode(shared, out.names), out).withColumnRenamed("c0", id_col)
