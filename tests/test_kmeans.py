"""K-means: seeding, monotone costs, the plain algorithm from the same seeds, silhouettes, labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetlens.operators import cluster as C
from budgetlens.operators import kmeans as K

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.6, (80, 3)) for m in ((0, 0, 0), (4, 0, 1), (0, 5, 2))] + [np.tile([[9.0, 9.0, 9.0]], (20, 1))])
    rows = [(int(i), *map(float, v)) for i, v in enumerate(x)] + [(900, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double").repartition(4).cache()


def test_sweep_matches_plain_steps_and_costs_fall_with_k(blobs):
    rows = K.standardised(blobs, COLUMNS, "key")
    x = np.array([r.x for r in rows.collect()])
    first = K.seeds(rows, 3, 5)
    for s in range(3):
        assert all((np.abs(x - c).sum(axis=1) < 1e-12).any() for c in first[s])  # centres are rows
    for start, (centres, cost) in zip(first, K.lloyd(rows, list(first)), strict=True):
        c, before = start.copy(), np.inf
        while True:
            to = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            here = ((x - c[to]) ** 2).sum()
            new = np.array([x[to == k].mean(axis=0) if (to == k).any() else c[k] for k in range(5)])
            assert here <= before + 1e-9
            if ((new - c) ** 2).sum() <= K.TOLERANCE or here >= before:
                break
            c, before = new, here
        assert np.allclose(c, centres, atol=1e-9) and here == pytest.approx(cost)
    fits = K.sweep(blobs, COLUMNS, "key", [2, 3, 4, 5], starts=4)
    assert [f.inertia for f in fits] == sorted((f.inertia for f in fits), reverse=True)
    assert max(fits, key=lambda f: f.silhouette).k == 4


def test_silhouette_and_labels_agree_with_the_column_form(blobs):
    fit = K.sweep(blobs, COLUMNS, "key", [4], starts=5)[0]
    out = K.labelled(blobs, COLUMNS, fit)
    assert sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [20, 80, 80, 80] and out.count() == 260
    z = K.standardised(blobs, COLUMNS, "key").select(*[F.col("x")[i].alias(c) for i, c in enumerate(COLUMNS)], F.col("id").alias("key"))
    named = K.labelled(z, COLUMNS, fit)
    assert C.silhouette_squared(named, COLUMNS, "cluster").first().silhouette == pytest.approx(fit.silhouette, abs=1e-9)
    again = K.sweep(blobs.repartition(7), COLUMNS, "key", [4], starts=5)[0]
    assert np.allclose(again.centres, fit.centres)


def test_one_distinct_row_and_no_rows(spark):
    df = spark.createDataFrame([(k, 1.0, 2.0) for k in range(6)], "key long, a double, b double")
    fit = K.sweep(df, ["a", "b"], "key", [2], starts=2)[0]
    assert fit.inertia == 0 and fit.silhouette == 0
    with pytest.raises(ValueError):
        K.seeds(K.standardised(df.where("key < 0").withColumn("a", F.lit(1.0)), ["a", "b"], "key"), 2, 2)


def test_block_sums_equal_a_plain_assignment_with_ties_to_the_first(monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 7)
    x = np.random.default_rng(2).integers(-2, 3, (40, 3)).astype(float)
    centres = np.array([[1.0, 0, 0], [-1.0, 0, 0], [1.0, 0, 0], [50.0, 0, 0]])
    got = sum(part for _, part in K._parts(x, {0: centres})).reshape(4, 5)
    d = ((x[:, None] - centres) ** 2).sum(axis=2)
    to = d.argmin(axis=1)
    for k in range(4):
        assert np.allclose(got[k], [d[to == k, k].sum(), (to == k).sum(), *x[to == k].sum(axis=0)])


def test_sums_beyond_the_direct_bound_meet_in_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(50)], "id long, x array<double>").repartition(4)
    models = [np.array([[0.0, 1.0], [2.0, 1.0]]), np.array([[1.0, 1.0]])]
    both = []
    for limit in (K.DIRECT_BYTES, 0):
        monkeypatch.setattr(K, "DIRECT_BYTES", limit)
        both.append([(c.tolist(), cost) for c, cost in K.lloyd(rows, models)])
    assert all(np.allclose(a[0], b[0]) and np.isclose(a[1], b[1]) for a, b in zip(*both, strict=True))


def test_packed_rows_give_the_same_fits_and_sweeps_read_them(blobs, monkeypatch):
    rows = K.standardised(blobs, COLUMNS, "key")
    blocks = K.packed(rows)
    assert blocks.count() <= rows.rdd.getNumPartitions() < rows.count() == 260
    first, again = K.seeds(rows, 3, 4), K.seeds(blocks, 3, 4)
    assert np.array_equal(first, again)
    models = [first[0], first[1][:2], first[2]]
    for (a, cost), (b, same) in zip(K.lloyd(rows, models), K.lloyd(blocks, models), strict=True):
        assert np.allclose(a, b) and cost == pytest.approx(same)
    assert np.allclose(K.silhouettes(rows, models), K.silhouettes(blocks, models))
    read, lloyd = [], K.lloyd
    monkeypatch.setattr(K, "lloyd", lambda rows, models: read.append(rows.schema["x"].dataType.typeName()) or lloyd(rows, models))
    K.sweep(blobs, COLUMNS, "key", [2], starts=1)
    assert read == ["binary"]


def test_models_of_equal_size_are_worked_out_together(monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 3))
    now = {5: rng.normal(size=(3, 3)), 2: rng.normal(size=(2, 3)), 9: rng.normal(size=(3, 3))}
    together = dict(K._parts(x, now))
    assert set(together) == set(now)
    for m, c in now.items():
        assert np.allclose(together[m], dict(K._parts(x, {m: c}))[m])
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        to = d.argmin(axis=1)
        assert np.allclose(together[m].reshape(len(c), 5), [[d[to == k, k].sum(), (to == k).sum(), *x[to == k].sum(axis=0)] for k in range(len(c))])
    with_calls, sums = [], K._sums
    monkeypatch.setattr(K, "_sums", lambda ones, norm, models, centres: with_calls.append(models) or sums(ones, norm, models, centres))
    dict(K._parts(x, now))
    assert sorted(with_calls) == [1] * 7 + [2] * 7
