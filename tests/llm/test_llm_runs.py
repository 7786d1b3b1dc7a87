"""Periodic runs: Lyndon arrays, runs and collapsed texts against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from budgetlens.llm import periodic_runs, queries
from test_llm_text_ops import frame, sample_docs, words


def lyndon_lengths(s):
    out = []
    for i in range(len(s)):
        j, k = i + 1, i
        while j < len(s) and s[k] <= s[j]:
            k = k + 1 if s[k] == s[j] else i
            j += 1
        out.append(j - k)
    return out


def brute_runs(w, min_length=6, min_exponent=4.0):
    out = []
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(min_length, min_exponent * p) and not any(all(w[i + t] == w[i + t + q] for t in range(size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out)


def collapsed(w, runs):
    gone = {k for s, size, p in runs for k in range(s + p, s + size)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def looped(i, w):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 7), st.sampled_from([3, 3.5, 4]))
def test_groups_are_lyndon_words_and_give_all_runs(w, block, times, exponent):
    w = w[:10] + block * times + w[10:]
    group, size = periodic_runs.lyndon_groups(np.array([0, *w]))
    assert size[1:].tolist() == lyndon_lengths(w)
    roots = [tuple(w[i : i + size[i + 1]]) for i in range(len(w))]
    assert all((group[i + 1] == group[j + 1]) == (roots[i] == roots[j]) for i in range(len(w)) for j in range(i))
    assert [(s - 1, n, p) for s, n, p in periodic_runs.find_runs(np.array([0, *w]), 6, exponent)] == brute_runs(w, 6, exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=9), st.integers(1, 6)), max_size=8), st.lists(st.integers(0, 60), max_size=3))
def test_cuts_lose_no_run(blocks, cuts):
    w = [x for b, k in blocks for x in b * k]
    first = sorted([0, len(w), *(min(c, len(w)) for c in cuts)])
    want = sorted((a + s, n, p) for a, b in zip(first[:-1], first[1:], strict=True) for s, n, p in brute_runs(w[a:b]))
    hashed = np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert periodic_runs.slice_runs(hashed, np.array(first), 6, 4) == want


def runs_rows(seed=5):
    rng = random.Random(seed)
    rows = sample_docs(seed, 60)
    for i in range(60, 120):
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        rows.append((i, " ".join(["x", *block * rng.randrange(1, 8), *block[: rng.randrange(3)], "y"]) + rng.choice(["", "\n"])))
    return rows + [(None, "a b " * 9), (3, "a " * 9), (3, "a " * 9), (200, None), (201, ""), (202, "la " * 30_000), (203, "é 日本\t" * 5)]


def test_runs_of_documents_match_brute_force(spark):
    rows = runs_rows()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(frame(spark, rows)).collect())
    want = []
    for i, t in rows:
        w = words(t)
        runs = [(0, 30_000, 1)] if i == 202 else brute_runs(w)
        want.append(((i is None, i or 0), len(w), runs, collapsed(w, runs).decode()))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(frame(spark, rows), min_exponent=2)


def test_op11_columns_match_brute_force(spark, tmp_path):
    rows = [r for r in runs_rows(6) if r[0] != 202]
    path = str(tmp_path)
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        w = words(t) if i is None else looped(i, words(t))
        runs = brute_runs(w)
        best = min(((-n, s, p) for s, n, p in runs), default=None)
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        want.append((i, len(runs), *top, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(collapsed(w, runs))))
    got = queries.QUERIES["op11_periodic_runs"](spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20
