"""Line dedup, substring dedup, Jaccard join, BPE: brute force on small tables, edge cases, DuckDB gate."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from budgetlens.llm import bpe, jaccard_join, line_dedup, substring_dedup
from budgetlens.llm.components import connected_components
from budgetlens.llm.mphf import PerfectHash

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_lines int, drops string, kept string, id string, part int, node string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    """(doc_id, text) rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "x", "y", "z", 1, None) for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def sample_docs(seed, n, size=60):
    """Texts with shared passages, copies, near copies, blank and repeated lines, nulls."""
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)] + ["É", "THE", "the", "日本"]
    passage = [rng.choice(pool) for _ in range(50)]
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        w = [rng.choice(pool) for _ in range(rng.randrange(1, size))]
        if kind == 0 and out:
            w = words(out[rng.randrange(len(out))][1])
            w = [x.decode() for x in w]
        elif kind == 1 and out:
            w = [x.decode() for x in words(out[rng.randrange(len(out))][1])]
            for _ in range(rng.randrange(1, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(pool)
        elif kind == 2:
            at = rng.randrange(len(w))
            w[at:at] = passage
        elif kind == 3:
            out.append((i, rng.choice([None, "", " \n\t ", "one", "one two three"])))
            continue
        text = "".join(x + rng.choice([" ", " ", "\n", "\t"]) for x in w)
        if rng.random() < 0.3:
            text += "\n  A Line That Many Documents Hold \n"
        out.append((i, text))
    return out


# ------------------------------------------------------------------ perfect hash
def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(1)
    lo, hi = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    lo[:100] = 5  # equal halves must not matter
    table = PerfectHash.unpack(PerfectHash.build(lo, hi).pack())
    assert table.n == 20_000 and sorted(table.index(lo, hi)) == list(range(20_000))
    assert PerfectHash.build(lo[:0], hi[:0]).n == 0


# ------------------------------------------------------------------ line dedup
def brute_lines(rows, min_docs=3, min_chars=20):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    key = lambda line: line.strip(BLANK).translate(lower)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} if i is not None else ():
            if len(k) >= min_chars:
                held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got_lines(df):
    return [(r.doc_id, r.n_lines, r.n_dropped, r.kept or "") for r in df.collect()]


def test_line_dedup_matches_brute_force(spark):
    rng, long = random.Random(4), "x" * 30
    lines = ["", "short", "  The SAME line of many documents", "the same line of many documents\r", "Ünïcödé line of twenty 日本", "ünïcödé line of twenty 日本", "é" * 19, "é" * 20, long]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 7)))) for i in range(40)]
    rows += [(40, None), (41, ""), (None, long), (None, long + "\n" + long), (42, long * 20_000), (7, long), (7, long)]
    assert Counter(got_lines(line_dedup.dedup_lines(frame(spark, rows)))) == Counter(brute_lines(rows))


def test_line_dedup_digest_pipeline_form_and_empty_table(spark):
    rows = [(i, f"own line {i}\nanother line that is long enough") for i in range(5)] + [(9, None)]
    digest = {r.doc_id: r.kept for r in line_dedup.dedup_lines(frame(spark, rows), digest_only=True).collect()}
    assert digest == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in brute_lines(rows)}
    clean = line_dedup.without_repeated_lines(frame(spark, rows))
    assert clean.columns == frame(spark, rows).columns
    assert {r.doc_id: r.text for r in clean.collect()} == {i: (None if i == 9 else t) for i, _, _, t in brute_lines(rows)}
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_line_dedup_deals_a_hot_shard_over_copies(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    rows = [(i, "the line that every document holds\nown line number %030d" % (i // 2)) for i in range(400)]
    assert Counter(got_lines(line_dedup.dedup_lines(frame(spark, rows)))) == Counter(brute_lines(rows))


# ------------------------------------------------------------------ substring dedup
def brute_windows(rows, size):
    where = defaultdict(list)
    for d, (_, t) in enumerate(rows):
        w = words(t)
        for p in range(len(w) - size + 1):
            where[tuple(w[p : p + size])].append((d, p))
    gone = {(d, p + k) for spots in where.values() if len(spots) > 1 for d, p in spots for k in range(size)}
    out = []
    for d, (i, t) in enumerate(rows):
        w = words(t)
        kept = [x for p, x in enumerate(w) if (d, p) not in gone]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


def got_windows(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("size", [35, 9, 3, 1])
def test_substring_dedup_matches_brute_force(spark, size):
    rows = sample_docs(size, 60, 90) + [(None, "a b c " * 30), (3, "a b c " * 30), (3, "a b c " * 30), (100, "rep " * 20_000), (101, None)]
    assert got_windows(substring_dedup.dedup_substrings(frame(spark, rows), size)) == Counter(brute_windows(rows, size))


def test_substring_dedup_flushes_the_same_texts_at_every_run(spark, monkeypatch):
    def seen(window, parts, digest):  # instead of the extension: the order in which a part's texts come
        def run(batches):
            import pyarrow as pa

            from budgetlens.llm.substring_dedup import _ARROW, _RESULT, _TEXT

            keys = {}
            for b in batches:
                for part, kind, key in zip(*(b.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                    if kind == _TEXT:
                        keys.setdefault(part, []).append(str(key))
            yield pa.RecordBatch.from_pylist([{"part": p, "kind": _RESULT, "id": p, "kept": " ".join(k)} for p, k in keys.items()], schema=_ARROW)
        return run

    monkeypatch.setattr(substring_dedup, "_extend", seen)
    rows = [(i, f"w{i} " * 40) for i in range(200)] + [(None, None), (5, "w5 " * 40)]
    shuffled = [rows, rows[::-1], rows[1::2] + rows[::2]]
    got = [{r.doc_id: r.kept for r in substring_dedup.dedup_substrings(frame(spark, x).repartition(n)).collect()} for x, n in zip(shuffled, (1, 3, 7), strict=True)]
    assert sum(len(k.split()) for k in got[0].values()) == len(rows)
    assert got[0] == got[1] == got[2]


def test_substring_dedup_empty_table(spark):
    assert substring_dedup.dedup_substrings(frame(spark, [])).collect() == []


def test_covers_meet_every_pair_of_residues():
    for v, residues in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in residues for b in residues} == set(range(v))


# ------------------------------------------------------------------ Jaccard join
def sets_of(text, size=5):
    w = [x.lower() for x in words(text)]  # bytes.lower changes A-Z only
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size=5, percent=80):
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        best[find(k)].append(i)
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in best.items()}
    return Counter((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def got_components(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_jaccard_join_matches_brute_force(spark):
    rows = sample_docs(11, 150) + [(None, "one two three"), (None, None), (0, "one two three"), (500, "w " * 20_000)]
    assert got_components(jaccard_join.jaccard_components(frame(spark, rows))) == brute_components(rows)


def test_jaccard_join_near_copies_around_the_threshold(spark, monkeypatch):
    """A large group whose members link to the base or only to each other; small tiles and hubs."""
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "BIG_GROUP", 20)
    monkeypatch.setattr(jaccard_join, "HUB_PEERS", 8)
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 3
    assert got_components(jaccard_join.jaccard_components(frame(spark, rows))) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 2**32))
def test_linked_sets_share_a_signature(size, changes, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    gone = rng.random(len(a)) < changes / 500
    b = np.unique(np.concatenate((a[~gone], rng.integers(0, 1 << 63, changes // 4, dtype=np.uint64))))
    if len(b) and not np.array_equal(a, b) and jaccard_join.linked(a, b, 80):
        assert np.intersect1d(jaccard_join.signatures(a, 80), jaccard_join.signatures(b, 80)).size
        x, y = (np.array([len(s)]) for s in (a, b))
        assert jaccard_join.sketches_allow([jaccard_join.sketch(a)], [jaccard_join.sketch(b)], x, y, 80)[0]


def test_jaccard_keep_one_and_empty_table(spark):
    rows = [(3, "a b c d e f g"), (1, "A B C D E F G"), (2, "other words here"), (4, None), (5, None), (None, "a b c d e f g")]
    assert sorted((r.doc_id or 0) for r in jaccard_join.keep_one(frame(spark, rows)).collect()) == [0, 1, 2, 4, 5]
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []


def test_jaccard_keep_one_judges_rows_not_ids(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "a text of its own that no other row holds"), (3, "p q r s t u v"), (3, "p q r s t u v"), (4, None), (4, None), (None, "p q r s t u v")]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[2], rows[3], (4, None), (4, None), rows[7]])


def test_connected_components_of_a_path_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(900, 901), (3, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 40)} | {900: 900, 901: 900}


# ------------------------------------------------------------------ BPE
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


HARD = ["", "it's we're I'll they'd 'sam 're 'x 'l ''s !'s  's\n's it's's 'S", "a  b\n\n c \t d  ", "  ", "\n", "x  ", "'", "'re", "a" * 5000, "hello<|endoftext|>world <|endoftext|>",
        "<|endoftext|>", "é ê𝔘 ½² 一二三 'été", "　x y\xa0z", "\x1c\x1d a\x1f b\x85c", "12 345a6 7'8", "👍🏽🙂", "a'\nb", " 'll", "x'sé", "'rE 're's 'lla", "'vé'vee", "Ᲊ Ɤ", "\x00\x01"]


def test_encoding_matches_the_library(library):
    rng = random.Random(3)
    parts = list("ab'st relvmd  \n\t!1é½漢🙂 .,S") + ["'s", "'re", "<|endoftext|>", "aa"]
    texts = HARD + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(1500)]
    e = bpe.Encoder(bpe.tokenizer_bytes(PATH))
    import pyarrow as pa

    for limit in (1 << 20, 50):
        got = [x.tolist() for _, _, raw, off in bpe.text_slices(pa.array(texts, pa.large_string()), limit) for x in e.encode_slice(raw, off)]
        assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [e.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got] == texts


def test_op2_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "no id"), (5, "same id"), (99, None), (98, "long word " * 30_000)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(frame(spark, rows), PATH, output="digests").collect())
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert got == Counter((i, len(x), digest(",".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for i, x in ids)
    encoded = bpe.encode(frame(spark, rows), PATH)
    assert Counter((r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()) == Counter((i, t or "") for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, [1, None, 10**6, 2])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: None, 2: library.decode([1, 2])}
    assert bpe.encode(frame(spark, []), PATH).collect() == []
