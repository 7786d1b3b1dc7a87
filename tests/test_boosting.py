"""Histogram trees: against a plain greedy program, both ways of training, limits, draws."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from budgetlens.operators import boosting as B

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 1000
    a, b, d = rng.normal(size=n).round(2), rng.integers(0, 5, n).astype(float), rng.integers(0, 2, n).astype(float)
    c = np.where(rng.random(n) < 0.1, np.nan, rng.random(n).round(3))
    y = (a + 0.5 * b * d + rng.normal(size=n) * 0.5 > 1).astype(int)
    rows = [(int(i), float(a[i]), float(b[i]), None if np.isnan(c[i]) else float(c[i]), float(d[i]), int(y[i]), int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, d double, y int, fold int").repartition(5).cache()


def plain_tree(x, g, h, depth, l2, least, n_least=1):
    """{row: value} by exhaustive search of the same cuts."""
    def grow(rows, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-9, None, None)
        if depth:
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[:-1]:
                    low = x[rows, j] <= cut
                    gl, hl = g[rows][low].sum(), h[rows][low].sum()
                    if min(hl, H - hl) < least or min(low.sum(), (~low).sum()) < n_least:
                        continue
                    gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                    if gain > best[0] * (1 + 1e-10):
                        best = (gain, j, cut)
        if best[1] is None:
            value[rows] = -G / (H + l2)
            return
        low = x[rows, best[1]] <= best[2]
        grow(rows[low], depth - 1)
        grow(rows[~low], depth - 1)

    value = np.zeros(len(x))
    grow(np.arange(len(x)), depth)
    return value


def test_boosting_matches_a_plain_program(data):
    spec = B.TreeSpec(rounds=5, rate=0.3, depth=3, l2=1.0, least_hessian=1.0)
    model = B.fit(data, spec, COLUMNS, "y", "key")
    pdf = data.toPandas()
    codes, y = model.bins.codes(pdf[COLUMNS].to_numpy(float)), pdf["y"].to_numpy(float)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(5):
        p = 1 / (1 + np.exp(-margin))
        margin += 0.3 * plain_tree(codes.astype(int), p - y, p * (1 - p), 3, 1.0, 1.0)
    assert np.allclose(model.margin(codes), margin, atol=1e-9)
    got = {r.key: r.p for r in B.predictions(data, model, COLUMNS, "y", "key").collect()}
    assert np.allclose([got[k] for k in pdf["key"]], 1 / (1 + np.exp(-margin)), atol=1e-9)


SPECS = {
    "levels": B.TreeSpec(rounds=3, rate=0.2, depth=4, l2=1.0, least_hessian=2.0, row_share=0.8, column_share=0.75),
    "best first": B.TreeSpec(rounds=2, rate=0.1, leaves=9, least_rows=20),
    "forest": B.TreeSpec(kind="forest", rounds=2, node_columns=2, least_rows=2, depth=4, balanced=True),
}


def test_training_in_tasks_and_over_rows_give_the_same_models(data, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 2)  # margins are written on the way
    both = []
    for local in (True, False):
        out = B.cross_scores(data, SPECS, COLUMNS, "y", "key", "fold", 3, local=local)
        both.append({(r.model, r.k): (r.fold, r.label, round(r.p, 9)) for r in out.collect()})
    assert both[0] == both[1] and len(both[0]) == 3 * 1000
    assert all(int(k) % 3 == fold for (_, k), (fold, _, _) in both[0].items())


def test_best_first_takes_the_largest_gains(data):
    few, more = (B.fit(data, B.TreeSpec(rounds=1, rate=1.0, leaves=n, least_rows=5), COLUMNS, "y", "key").trees[0] for n in (4, 12))
    assert [sum(f < 0 for f in t.feature) for t in (few, more)] == [4, 12]
    assert few.feature[0] == more.feature[0] and few.sums[0] == more.sums[0]
    assert min(n for (_, _, n), f in zip(more.sums, more.feature, strict=True) if f < 0) >= 5


def test_forest_learns_and_draws_do_not_depend_on_order(data):
    spec = B.TreeSpec(kind="forest", rounds=30, node_columns=2, least_rows=2, balanced=True)
    one, two = (B.fit(d, spec, COLUMNS, "y", "key") for d in (data, data.repartition(2)))
    assert [t.sums for t in one.trees] == [t.sums for t in two.trees]
    pdf = data.toPandas()
    p = one.probability(one.bins.codes(pdf[COLUMNS].to_numpy(float)))
    assert ((p > 0.5) == pdf["y"]).mean() > 0.9 and 0 <= p.min() and p.max() <= 1
    times = B.row_weights(np.arange(20_000), spec, 0)
    assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.02


def test_one_class_and_constant_columns(spark):
    df = spark.createDataFrame([(k, 1.0, None, 1) for k in range(20)], "key long, a double, b double, y int")
    model = B.fit(df, B.TreeSpec(rounds=3, depth=3), ["a", "b"], "y", "key")
    assert all(t.feature == [-1] for t in model.trees)
    assert all(r.p > 0.999 for r in B.predictions(df, model, ["a", "b"], "y", "key").collect())


def test_parts_of_a_forest_are_trained_apart_and_keep_rows_of_equal_or_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(B, "FOREST_PART", 2)
    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else i // 2, float(a), int(a + rng.normal() * 0.5 > 0), i % 2) for i, a in enumerate(rng.normal(size=400).round(2))]
    df = spark.createDataFrame(rows, "key long, a double, y int, fold int")
    spec = B.TreeSpec(kind="forest", rounds=5, node_columns=1, least_rows=2)
    assert B._parts(spec) == [[0, 1], [2, 3], [4]]
    assert B._parts(B.TreeSpec(rounds=5)) == [list(range(5))]
    both = [sorted((str(r.k), r.fold, r.label, round(r.p, 9)) for r in B.cross_scores(df, {"f": spec, "b": B.TreeSpec(rounds=2, depth=2)}, ["a"], "y", "key", "fold", 2, local=local).collect()) for local in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 800


def test_written_out_bins_and_sorted_cells_give_the_same_splits():
    rng = np.random.default_rng(4)
    codes = np.asfortranarray(np.column_stack((rng.integers(0, 255, 3000), rng.integers(0, 2, 3000), rng.integers(0, 2, 3000), rng.integers(0, 40, 3000))).astype(np.uint8))
    g, h = rng.normal(size=3000) + codes[:, 1], rng.random(3000) + 0.1
    at = np.sort(rng.integers(0, 4, 3000))
    spec = B.TreeSpec(l2=1.0, least_rows=3)
    slots = B.node_columns(np.arange(4), spec, 0, range(4))
    dense = B.level_splits(codes, np.arange(3000), at, slots, g, h, spec, codes.max(axis=0).astype(int) + 1)
    cells = B.best_splits(*B.cells_of(codes, slots, at, g, h), slots, spec)
    assert [(s[1][1:3], s[1][5], s[0][2]) for s in dense] == [(s[1][1:3], s[1][5], s[0][2]) for s in cells]
    assert np.allclose([s[1][0] for s in dense], [s[1][0] for s in cells])


def test_a_million_rows_of_forty_columns_are_trained_in_tasks(spark):
    assert B.fits_tasks(spark.range(1_000_000), [f"c{i}" for i in range(40)])


def test_columns_of_few_bins_share_a_byte_and_the_larger_sibling_is_not_read(monkeypatch):
    rng = np.random.default_rng(6)
    codes = np.asfortranarray(np.column_stack([rng.integers(0, 200, 4000), *(rng.integers(0, 2, 4000) for _ in range(9)), rng.integers(0, 5, 4000)]).astype(np.uint8))
    y = (codes[:, 0] / 200 + codes[:, 3] * codes[:, 10] / 5 + rng.random(4000) > 1.2).astype(float)
    lay = B.layout(codes.max(axis=0).astype(int) + 1)
    assert lay.wide == [0] and len(lay.packs) == 2 and sorted(lay.narrow) == list(range(1, 11))
    read, add = [], B.bin_sums
    monkeypatch.setattr(B, "bin_sums", lambda arrays, rows, *a, **k: read.append(len(rows) * len(arrays)) or add(arrays, rows, *a, **k))
    spec = B.TreeSpec(rounds=2, depth=4, l2=1.0, least_hessian=1.0)
    model = B.train(codes, y, np.arange(4000), None, spec)
    assert sum(read) <= 2 * 4000 * 3 * (1 + 3 / 2)
    margin = np.full(4000, np.log(y.mean() / (1 - y.mean())))
    for _ in range(2):
        p = 1 / (1 + np.exp(-margin))
        margin += 0.1 * plain_tree(codes.astype(int), p - y, p * (1 - p), 4, 1.0, 1.0)
    assert np.allclose(model.margin(codes), margin, atol=1e-9)


def test_forests_leave_pure_nodes_alone_and_count_classes_exactly():
    rng = np.random.default_rng(7)
    codes, y, ids = np.asfortranarray(rng.integers(0, 30, (500, 4)).astype(np.uint8)), (rng.random(500) < 0.3).astype(float), np.arange(500)
    spec = B.TreeSpec(kind="forest", rounds=1, node_columns=2, least_rows=2, balanced=True)
    tree = B.train(codes, y, ids, None, spec).trees[0]
    weights = B.class_weights(y, spec) * B.row_weights(ids, spec, 0)
    at = tree.routed(codes)
    for v in set(at[weights > 0].tolist()):
        on = at == v
        assert np.allclose(tree.sums[v][:2], (-(y * weights)[on].sum(), weights[on].sum()), atol=1e-9)
    growing = B.grower(B.Tree(), spec)
    assert next(growing) == [0]
    with pytest.raises(StopIteration):  # both children hold one class
        growing.send({0: ((-5.0, 10.0, 10), (5.0, 0, 3, -5.0, 5.0, 5))})


def test_sums_added_up_by_the_driver_and_by_a_shuffle_give_the_same_models(data, monkeypatch):
    specs = {k: v for k, v in SPECS.items() if k != "forest"}
    both = []
    for limit in (B.DIRECT_BYTES, 0):
        monkeypatch.setattr(B, "DIRECT_BYTES", limit)
        out = B.cross_scores(data, specs, COLUMNS, "y", "key", "fold", 3, local=False)
        both.append({(r.model, r.k): round(r.p, 9) for r in out.collect()})
    assert both[0] == both[1] and len(both[0]) == 2 * 1000


def test_bins_are_exact_quantiles_outside_each_fold_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(B, "SUMMARY_CELLS", 600)  # several summaries in a task
    rng = np.random.default_rng(9)
    n = 3000
    a, b = rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    rows = [(None if i % 7 == 0 else float(a[i]), float("nan") if i % 11 == 0 else float(b[i]), None, None if i % 13 == 0 else i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "`a.b` double, b double, c double, fold int").repartition(3)
    found, fold = B.fit_bins(df, ["a.b", "b", "c"], "fold", [0, 1, 2]), np.array([-1 if r[3] is None else r[3] for r in rows])
    for f, bins in found.items():
        for j in range(2):
            x = np.sort([r[j] for r, of in zip(rows, fold, strict=True) if of not in (-1, f) and r[j] is not None])
            want = x[np.ceil(np.array([k / B.BINS for k in range(1, B.BINS)]) * len(x)).astype(int) - 1]
            assert np.array_equal(bins.edges[j], np.unique(want), equal_nan=True) and bins.fill[j] == want[127]
        assert bins.edges[2].tolist() == [0.0]
    whole = B.fit_bins(df, ["b"], None, [None])[None]
    assert np.array_equal(whole.edges[0], [0, 1, 2, np.nan], equal_nan=True)


def test_summaries_keep_ranks_and_stay_small(monkeypatch):
    monkeypatch.setattr(B, "SUMMARY", 100)
    x = np.random.default_rng(10).normal(size=5000)
    value, rows = B._summary(x)
    assert len(value) == 100 and rows.sum() == 5000 and value[-1] == x.max()
    assert all(abs((x <= v).sum() - upto) == 0 for v, upto in zip(value, np.cumsum(rows), strict=True)) and rows.max() <= 2 * 5000 / 100
    again, both = B._summary(np.concatenate((value, value)), np.concatenate((rows, rows)))
    assert np.array_equal(again, value) and np.array_equal(both, 2 * rows)


def test_rows_reach_the_tasks_once_with_bins_of_every_fold(data):
    bins = B.fit_bins(data, COLUMNS, "fold", [0, 1, 2])
    local = B._collected(B._frame(data, COLUMNS, "y", "key", "fold"), bins)
    x = {str(r.key): [np.nan if r[c] is None else r[c] for c in COLUMNS] for r in data.collect()}
    rows = np.array([x[k] for k in local.keys.to_pylist()], float)
    at = np.arange(0, 1000, 3)
    for f, own in bins.items():
        assert np.array_equal(local.under(f, at), own.codes(rows[at]))


def test_large_nodes_are_added_up_by_several_arrays_at_once(monkeypatch):
    rng = np.random.default_rng(11)
    codes = np.asfortranarray(np.column_stack([rng.integers(0, 250, 6000), rng.integers(0, 200, 6000), rng.integers(0, 30, 6000), *(rng.integers(0, 2, 6000) for _ in range(9))]).astype(np.uint8))
    y = (codes[:, 0] / 250 + codes[:, 4] * codes[:, 2] / 30 + rng.random(6000) > 1.2).astype(float)
    for spec in (B.TreeSpec(rounds=3, depth=4, l2=1.0, row_share=0.8, column_share=0.7), B.TreeSpec(rounds=2, leaves=9, least_rows=20), B.TreeSpec(kind="tree", rounds=1, depth=5, balanced=True)):
        both = []
        for limit in (1 << 15, 500):
            monkeypatch.setattr(B, "JOINT_ROWS", limit)
            both.append(B.train(codes, y, np.arange(6000), None, spec).trees)
        for one, two in zip(*both, strict=True):
            assert (one.feature, one.cut, one.left) == (two.feature, two.cut, two.left) and np.allclose(one.sums, two.sums)
            used = B.row_weights(np.arange(6000), spec, both[0].index(one)) > 0
            assert [s[2] for s, f in zip(one.sums, one.feature, strict=True) if f < 0] == [int((one.routed(codes)[used] == v).sum()) for v, f in enumerate(one.feature) if f < 0]
    many = B.joint([codes[:, j] for j in range(12)])
    assert len(many.arrays) < 12 and all(np.prod([many.sizes[k] for k in group]) <= B.JOINT_CELLS for group in many.groups)


@pytest.mark.parametrize("limits", [{}, {"VOTE_ROWS": 4, "VOTE_BLOCK": 40, "GATHER": 2}, {"VOTE_ROWS": 10**6}, {"VOTE_ROWS": 1, "VOTE_BLOCK": 7}])
@pytest.mark.parametrize("least", [1, 3])
def test_votes_in_one_number_give_the_sums_and_splits_of_each_class(monkeypatch, limits, least):
    rng = np.random.default_rng(3)
    codes = np.asfortranarray(np.column_stack([rng.integers(0, k, 900) for k in (255, 2, 3, 255, 7, 1)]).astype(np.uint8))
    y = (codes[:, 0] + 60.0 * codes[:, 1] + rng.normal(0, 60, 900) > 150).astype(float)
    spec, ids = B.TreeSpec(kind="forest", rounds=2, least_rows=least, balanced=True, node_columns=3), np.arange(900) * 31 + 7
    for name, value in limits.items():
        monkeypatch.setattr(B, name, value)
    got = B.train(codes, y, ids, None, spec)
    called = []
    monkeypatch.setattr(B, "vote_splits", lambda codes, rows, at, slots, draws, *a: called.append(1) or [
        # sums of each class and cell by themselves
        plain_split(codes, rows[at == v], slots[v], draws, spec, a[2]) for v in range(len(slots))])
    want = B.train(codes, y, ids, None, spec)
    assert called
    for a, b in zip(got.trees, want.trees, strict=True):
        assert len(a.feature) > 60 and a.feature == b.feature and a.cut == b.cut and a.left == b.left
        assert np.allclose(a.sums, b.sums, rtol=1e-12, atol=1e-9)


def plain_split(codes, rows, columns, draws, spec, votes):
    times, label = draws[rows] >> 1, draws[rows] & 1
    weight = times * np.where(label == 1, votes[0], votes[1])
    G, H, n = -(weight * label).sum(), weight.sum(), len(rows)
    best = B.NONE
    for j in columns:
        for cut in np.unique(codes[rows, j])[:-1]:
            low = codes[rows, j] <= cut
            gl, hl, nl = -(weight * label)[low].sum(), weight[low].sum(), int(low.sum())
            if min(hl, H - hl) >= spec.least_hessian and min(nl, n - nl) >= spec.least_rows:
                gain = gl**2 / hl + (G - gl) ** 2 / (H - hl) - G**2 / H
                if gain > max(best[0] * (1 + 1e-10), 1e-9 * max(1.0, abs(G))):
                    best = (gain, int(j), int(cut), gl, hl, nl)
    return (G, H, n), best


def test_tasks_that_read_their_rows_give_the_scores_of_broadcast_rows(data, monkeypatch):
    specs = {"boost": B.TreeSpec(rounds=6, rate=0.3, depth=3, row_share=0.8, l2=1.0, least_hessian=1.0),
             "forest": B.TreeSpec(kind="forest", rounds=20, least_rows=2, balanced=True, node_columns=2)}
    twice = data.unionByName(data.where("key < 40")).withColumn("key", F.expr("if(key = 7, null, key)"))  # keys repeat or are missing
    monkeypatch.setattr(B, "FOREST_PART", 6)
    order = ["model", "fold", "k", "label", "p"]
    want = sorted(map(tuple, B.cross_scores(twice, specs, COLUMNS, "y", "key", "fold", 3).select(order).collect()), key=str)
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    monkeypatch.setattr(B, "OUT_ROWS", 50)
    monkeypatch.setattr(B, "over_rows", None)  # a job a level must not run
    added = B._added
    monkeypatch.setattr(B, "_added", lambda found, todo: lists.append(found.rdd.getNumPartitions()) or added(found, todo))
    lists = []
    got = sorted(map(tuple, B.cross_scores(twice, specs, COLUMNS, "y", "key", "fold", 3).select(order).collect()), key=str)
    assert len(got) == len(want) == 2 * 1040
    assert lists[0] > 6  # each list of work is a task by itself
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-12)


def test_work_is_dealt_to_lists_of_one_fold():
    tasks = [B.Task(n, f, B.TreeSpec(kind="forest", rounds=40)) for n in "ab" for f in range(3)]
    lists = B._dealt(tasks, 6)
    assert sorted(x for pieces in lists for x in pieces) == [(i, j, part) for i, t in enumerate(tasks) for j, part in enumerate(B._parts(t.spec))]
    assert all(len({tasks[i].fold for i, _, _ in pieces}) == 1 for pieces in lists) and len(lists) <= 24
