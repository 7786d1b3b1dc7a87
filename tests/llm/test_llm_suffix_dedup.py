"""Suffix-array dedup: brute force over all windows, hot keys, edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from budgetlens.llm import suffix_dedup
from test_llm_text_ops import frame, sample_docs


def brute_bytes(rows, window):
    """Rows as (id, text); rows equal in both are judged alike, rows of one id by the order that ``tie`` gives their texts."""
    texts = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, gone = set(), {}
    for key in texts:
        b, out = key[2].encode(), set()
        for x in range(len(b) - window + 1):
            s = b[x : x + window]
            if s in seen:
                out.update(range(x, x + window))
            seen.add(s)
        gone[key] = out
    out = []
    for i, t in rows:
        b, g = (t or "").encode(), gone[i is not None, i or 0, t or ""]
        spans = sum(k in g and k - 1 not in g for k in range(len(b)))
        out.append((i, len(b), len(g), spans, bytes(x for k, x in enumerate(b) if k not in g)))
    return Counter(out)


def got_bytes(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def copies(seed, n):
    """Texts with copies, edits, long passages, loops, one letter and raw Unicode."""
    rng = random.Random(seed)
    rows = sample_docs(seed, n, 60)
    passage = "".join(rng.choice("abcdef ghij") for _ in range(300))
    for i in range(n, 2 * n):
        kind = rng.randrange(6)
        old = rows[rng.randrange(len(rows))][1] or "x"
        if kind == 0:
            t = old[rng.randrange(len(old)) :] + old
        elif kind == 1:
            t = "".join(rng.choice("xyz") if rng.random() < 0.02 else c for c in old * 2)
        elif kind == 2:
            t = f"{i} " + passage[rng.randrange(200) :][: rng.randrange(300)] + f" {i * 7}"
        elif kind == 3:
            t = "ab" * rng.randrange(90) + "q" * rng.randrange(200)
        elif kind == 4:
            t = "日本é" * rng.randrange(40) + old[:50]
        else:
            t = old[:90] + passage[:99] + old[90:]
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("window", [100, 33, 16])
def test_dedup_bytes_matches_brute_force(spark, window, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", (2000, 1 << 20))
    rows = copies(window, 60) + [(None, "null id " * 30), (3000, None), (3001, ""), (3002, "z" * 4000), (3003, "tail " * 50), (3003, "tail " * 50)]
    assert got_bytes(suffix_dedup.dedup_bytes(frame(spark, rows).repartition(5), window)) == brute_bytes(rows, window)


def test_cut_texts_and_hot_keys_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", (2000, 1 << 20))  # read by the driver: several parts
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ghij") for _ in range(250))
    edges = [(i, f"{rng.random()}" + passage[: rng.randrange(80, 250)] + f"{rng.random()}") for i in range(200)]
    rows = edges + copies(4, 30)[30:]
    want = brute_bytes(rows, 40)
    for limits in ({"local": 2}, {"hot": 3}, {"piece": 64, "flush": 500, "members": 8}, {"piece": 64, "flush": 900, "local": 3, "hot": 5}):
        assert got_bytes(suffix_dedup.dedup_bytes(frame(spark, rows).repartition(3), 40, limits=limits)) == want, limits


def test_dedup_bytes_empty_tables_and_bounds(spark):
    assert suffix_dedup.dedup_bytes(frame(spark, [])).collect() == []
    assert got_bytes(suffix_dedup.dedup_bytes(frame(spark, [(1, None), (None, "a")]))) == Counter([(1, 0, 0, 0, b""), (None, 1, 0, 0, b"a")])
    with pytest.raises(ValueError):
        suffix_dedup.dedup_bytes(frame(spark, []), 15)


def test_every_window_shares_its_trigger_with_its_copies():
    rng = np.random.default_rng(3)
    a = rng.integers(97, 101, 400).astype(np.uint8)
    b = np.concatenate((rng.integers(97, 101, 57).astype(np.uint8), a[100:300], rng.integers(97, 101, 30).astype(np.uint8)))
    for reach in (8, 20, 50):
        x, y = suffix_dedup.anchors(a, reach), suffix_dedup.anchors(b, reach)
        assert (x[100 : 300 - reach - 7] - 100 == y[57 : 257 - reach - 7] - 57).all()
        assert ((x - np.arange(len(x)) >= 0) & (x - np.arange(len(x)) < reach)).all()


def test_window_marks_join_runs_and_split_long_ones():
    key, x = np.zeros(70_000, np.int64), np.arange(70_000)
    rows = list(suffix_dedup._window_marks(key, np.ones(70_000, np.int32), x[::-1]))
    _, lo, size, _, _ = suffix_dedup.unpack(rows[0][3])
    assert [(p, k) for p, k, _, _ in rows] == [(1, suffix_dedup._MARKS)] and lo.tolist() == [0, 65535] and size.tolist() == [65535, 4465]
