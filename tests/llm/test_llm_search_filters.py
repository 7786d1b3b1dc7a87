"""Top-k, WARC, URL filter, decontamination: brute force on small tables and edge cases."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from budgetlens.llm import decontaminate, topk, url_filter, warc


# ------------------------------------------------------------------ top-k
def brute_top(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in best.items()}
    out = Counter()
    for q in ints:
        if q % every == 0:
            score = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:k]
            out.update((q, r, c, -s) for r, (s, c) in enumerate(score, 1))
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(2)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # ties
    rows += [(10, None), (20, [None, 1.0]), (30, [float("nan")] * 12), (None, rows[0][1]), (40, [1.0, 2.0]), (5, rows[9][1]), (2000, []), (2010, [0.0] * 12), (2020, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame([(i, v, "a", 3, 1) for i, v in rows], "vec_id long, embedding array<double>, id string, rank int, score int")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 10, 10).collect())
    assert got == brute_top(rows, 10, 10)


def test_top_k_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(100, [1.0, 0.5]), (7, [-1.0, 2.0])], schema)
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(100, 1, 7, -1024 * 1024 + 512 * 2048)]
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []


def test_bound_stops_early_on_proof():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 16)) * 100).astype(np.int64)
    block = topk.Block(topk.pack(np.arange(4000), np.array(x.shape), x.ravel(), *topk.build_block(x)))
    w = x[17]
    best = np.sort(np.delete(x @ w, 17))[-10]
    left = block.possible(w, 17, float(best), 10)
    assert len(left) < 4000 and set(np.flatnonzero(x @ w >= best)) - {17} <= set(left.tolist())


# ------------------------------------------------------------------ WARC
def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_archive_matches_brute_force_and_is_ordered(spark):
    rng = random.Random(6)
    rows = [(i, f"http://{rng.choice(['a.b.org', 'www.b.org', 'z.net', ''])}/{rng.randrange(9)}?q=1#f", rng.choice(["", None, "<p>é</p>", "x" * 300_000, f"own {i}"])) for i in range(120)]
    rows += [(3, "http://again/", rows[3][2]), (3, "http://again/", rows[3][2]), (None, "http://n/", "<p>é</p>"), (500, None, "no url"), (501, "http://x/\r\nEvil: 1", "own")]
    for least in (0, 4):
        out = warc.archive(pages(spark, rows), min_bytes=least).collect()
        body = [(r[2] or "").encode() for r in rows]
        digest = [base64.b32encode(hashlib.sha1(b).digest()).decode() for b in body]
        first = {}
        for (i, _, _), d, b in zip(rows, digest, body, strict=True):
            if i is not None and len(b) >= least:
                first[d] = min(first.get(d, i), i)
        want, used = Counter(), set()
        for (i, _, _), d, b in zip(rows, digest, body, strict=True):
            response = i is None or len(b) < least or first[d] == i and d not in used
            if i is not None and first.get(d) == i:
                used.add(d)
            want[i, len(b), d, "response" if response else "revisit", None if response else first[d]] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
        keys = [(r.urlkey, r.timestamp, r.page_id is not None, r.page_id or 0) for r in out]
        assert keys == sorted(keys)
    assert warc.archive(pages(spark, [])).collect() == []


def test_archive_files_hold_what_the_index_says(spark, tmp_path):
    import gzip

    out = warc.archive(pages(spark, [(1, "http://a.org/x", "one"), (2, "http://b.org/", "one")]), folder=str(tmp_path)).collect()
    for r in out:
        data = (tmp_path / r.file).read_bytes()[r.offset : r.offset + r.length]
        text = gzip.decompress(data).decode()
        assert text.startswith("WARC/1.1\r\n") and f"WARC-Type: {r.record_type}\r\n" in text and f"sha1:{r.payload_digest}" in text
        assert ("one" in text.split("\r\n\r\n", 2)[2]) == (r.record_type == "response")


def test_damaged_payload_is_noticed():
    fields = {"WARC-Type": "response", "WARC-Payload-Digest": "sha1:AAAA", "WARC-Date": "d", "Content-Length": "1"}
    with pytest.raises(ValueError):
        warc.entry(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree_merges_sorted_runs(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# ------------------------------------------------------------------ URL filter
def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(8)
    names = ["com", "net", "org", "a.com", "b.a.com", "a.net", "xa.com", "com.a", "é.org", ""]
    rules = [(rng.choice(["block", "allow"]), rng.choice(names[:-1]), rng.choice(["", "/", "/en", "/en/", "/de/"])) for _ in range(25)] + [("block", "", "/")]
    urls = [f"{rng.choice(['http', 'HTTPS', 'x'])}://{rng.choice(['', 'www.', 'WWW.q.'])}{rng.choice(names)}{rng.choice(['', '/', '/en', '/en/x', '/de/?a', '#f', '?q=/en/', '/e?://com/'])}" for _ in range(300)]
    urls += [f"http://{n.replace(chr(46), chr(44))}/en/x" for n in names] + ["http://com,a/en/", "http://a,b.com/de/x", "http://b,a.com/"]  # commas are no dots
    urls += [None, "", "no scheme/en", "http://", "://net/", "http://com:80/en/"] + ["http://hot.b.a.com/en/1"] * 200
    df = spark.createDataFrame([(k if k % 50 else None, u, "h", "p", 0, 1) for k, u in enumerate(urls)], "page_id long, url string, host string, path string, part int, kind int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rules_frame(spark, rules)).collect())
    assert got == Counter((k if k % 50 else None, *brute_verdict(u, rules)) for k, u in enumerate(urls))


def test_url_filter_without_rules_or_urls(spark):
    schema = "verdict string, host string, path string"
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(df, spark.createDataFrame([("block", None, "/")], schema)).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark)).collect() == []


# ------------------------------------------------------------------ decontamination
def tokens(text):
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in "".join(c.lower() if c.isascii() else c for c in text or "")).split()


def edits(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (t != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    pool = [f"v{k}" for k in range(300)] + ["the", "of", "É"]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 45)))) for i in range(25)] + [(90, None), (91, ""), (92, "!!"), (None, " ".join(rng.choices(pool, k=20)))]
    docs = [(0, None), (1, ""), (2, "the of"), (None, items[0][1])]
    for i in range(3, 160):
        w = rng.choices(pool, k=rng.randrange(0, 120))
        if rng.random() < 0.6:
            part = tokens(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(0, len(part) // 4 + 1)):
                at = rng.randrange(len(part) + 1)
                change = rng.randrange(3)
                part[at : at + (change > 0)] = [rng.choice(pool)] if change < 2 else []
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    docs.append(docs[4])
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminations(df, bench).collect())
    want = Counter()
    for d, t in docs:
        for i, q in items:
            w = tokens(q)
            if w and (e := edits(w, tokens(t))) <= len(w) // 5:
                want[d, i, e] += 1
    found = Counter({k: min(v, got[k]) for k, v in want.items()})
    assert not {(d, i) for d, i, _ in got} - {(d, i) for d, i, _ in want}  # every row is verified
    assert sum(found.values()) >= 0.97 * sum(want.values())
    exact = {k for k in want if k[2] == 0}
    assert exact <= set(got)
    clean = decontaminate.keep_uncontaminated(df, bench)
    assert clean.columns == df.columns
    hit = {(d, t) for d, t in docs if any(k[0] == d for k in got)}
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in docs if x not in hit)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminations(docs, none).collect() == []
    assert decontaminate.contaminations(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert decontaminate.keep_uncontaminated(docs, none).count() == 1


def test_recall_at_the_largest_number_of_edits():
    import pyarrow as pa

    rng = random.Random(1)
    pool = [f"v{k}" for k in range(5000)]
    items = [" ".join(rng.choices(pool, k=rng.randrange(12, 60))) for _ in range(150)]
    index = decontaminate.ItemIndex(list(range(150)), items)
    texts = []
    for t in items * 2:
        w = t.split()
        for _ in range(len(w) // 5):
            at, change = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (change > 0)] = [rng.choice(pool)] if change < 2 else []
        texts.append(" ".join(rng.choices(pool, k=100) + w + rng.choices(pool, k=100)))
    got = {(at + d, i) for at, _, h, first in decontaminate.word_ids(pa.array(texts, pa.large_string())) for d, i, _, _ in index.matches(h, first)}
    assert sum((k, k % 150) in got for k in range(300)) >= 0.99 * 300


@pytest.mark.parametrize("size", [5, 12, 40, 41, 60, 100, 200, 400])
@pytest.mark.parametrize("kind", ["insertions", "substitutions", "deletions", "first words deleted", "insertions in one place"])
def test_recall_by_length_and_kind_of_edit(size, kind):
    import pyarrow as pa

    rng = random.Random(size)
    pool = [f"v{k}" for k in range(5000)]
    items = [" ".join(rng.choices(pool, k=size)) for _ in range(60)]
    index = decontaminate.ItemIndex(list(range(60)), items)
    texts = []
    for t in items:
        out, at = [], set(rng.sample(range(size), size // 5)) if kind in ("insertions", "substitutions", "deletions") else set()
        for k, w in enumerate(t.split()):
            out += [w] if k not in at else {"insertions": [rng.choice(pool), w], "substitutions": [rng.choice(pool)], "deletions": []}[kind]
        if kind == "first words deleted":
            out = out[size // 5 :]
        elif kind == "insertions in one place":
            out[size // 2 : size // 2] = rng.choices(pool, k=size // 5)
        texts.append(" ".join(rng.choices(pool, k=30) + out + rng.choices(pool, k=30)))
    got = {(at + d, i) for at, _, h, first in decontaminate.word_ids(pa.array(texts, pa.large_string())) for d, i, _, _ in index.matches(h, first)}
    assert sum((k, k) in got for k in range(60)) >= 59
    assert len(got) <= 60


def test_long_item_cut_at_one_end_or_at_the_text_border():
    import pyarrow as pa

    rng = random.Random(3)
    item = [f"v{k}" for k in rng.choices(range(5000), k=200)]
    texts = [item[40:], item[:160], ["x"] * 40 + item[40:], item[:160] + ["x"] * 40, item[41:], item[:80] + ["x"] * 41 + item[121:]]
    index = decontaminate.ItemIndex([7], [" ".join(item)])
    (_, _, h, first), = decontaminate.word_ids(pa.array([" ".join(t) for t in texts], pa.large_string()))
    assert [(d, i, e) for d, i, _, e in index.matches(h, first)] == [(0, 0, 40), (1, 0, 40), (2, 0, 40), (3, 0, 40)]
