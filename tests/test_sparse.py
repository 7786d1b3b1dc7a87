"""Level indices, sparse rows and Newton-CG fits against plain programs and the dense fit of the same objective."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from budgetlens.operators import models as MD
from budgetlens.operators import sparse as SP
from budgetlens.operators.linear import TOLERANCE, fit_linear


def coded(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 9, n), rng.integers(0, 3, n)
    a[: n // 3] = 4  # a level that a third of the rows share
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.8 * (a % 2) - 0.5 * (b == 1) + rng.normal(size=n) > 0.4).astype(int)
    rows = [(i, None if i % 17 == 0 else f"a{a[i]}", int(b[i]), x[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a string, b int, x array<double>, label int").repartition(5), rows


def test_level_numbers(spark):
    df, rows = coded(spark)
    index = SP.index_levels(df, ["a", "b"])
    levels = [("a", v) for v in sorted({r[1] for r in rows if r[1] is not None})] + [("b", v) for v in sorted({str(r[2]) for r in rows})]
    got = {(r.column, r.level): (r.idx, r.n) for r in index.table.collect()}
    want = {k: (i, sum((r[1] if k[0] == "a" else str(r[2])) == k[1] for r in rows)) for i, k in enumerate(levels)}
    assert got == want and index.width == len(levels)
    number = {k: i for i, k in enumerate(levels)}
    unknown = spark.createDataFrame([(-1, "never seen", 99, [0.0, 0.0], 0), (-2, None, None, [0.0, 0.0], 0)], df.schema)
    for r in SP.encode(df.unionByName(unknown), index).collect():
        assert list(r.levels) == [number[k] for k in (("a", r.a), ("b", str(r.b))) if k in number]


def test_empty_table_and_clashing_names(spark):
    df, _ = coded(spark, 30)
    index = SP.index_levels(df.limit(0), ["a", "b"])
    assert index.width == 0 and index.table.count() == 0
    clash = df.select("*", F.lit(1).alias("level"), F.lit(2).alias("idx"), F.lit(3).alias("column"), F.lit(4).alias("n"), F.lit(5).alias("a.b"))
    out = SP.encode(clash, SP.index_levels(clash, ["a", "level"]))
    assert out.columns == [*clash.columns, "levels"] and out.count() == 30
    with pytest.raises(ValueError):
        SP.fit_sparse(SP.encode(df, index).limit(0), 0, 1.0)


@pytest.mark.parametrize("loss", ["log", "squared hinge"])
@pytest.mark.parametrize("c", [0.05, 1.0, 50.0])
def test_same_optimum_as_the_dense_fit(spark, loss, c):
    df, _ = coded(spark)
    index = SP.index_levels(df, ["a", "b"])
    rows = SP.encode(df, index).withColumn("w", 0.5 + F.col("label")).cache()
    got = SP.fit_sparse(rows, index.width, c, loss, weight="w")
    dense = spark.createDataFrame([(Vectors.dense(list(r.x) + [float(i in r.levels) for i in range(index.width)]), r.label, r.w) for r in rows.collect()],
                                  ["features", "label", "w"])
    want = fit_linear(dense, c, loss, weight="w")
    assert got.gradient <= TOLERANCE
    assert np.allclose(np.concatenate((got.numeric, got.level, [got.intercept])), [*want.coef, want.intercept], atol=1e-5)
    margins = {r.id: r.margin for r in got.margin(rows).select("id", "margin").collect()}
    for r in rows.collect():
        assert margins[r.id] == pytest.approx(got.intercept + got.numeric @ np.array(r.x) + sum(got.level[i] for i in r.levels))


def test_blocks_and_slots_give_the_same_sums(spark, monkeypatch):
    df, _ = coded(spark)
    index = SP.index_levels(df, ["a", "b"])
    rows = SP.encode(df, index).select("x", "levels", (F.col("label") * 2.0 - 1).alias("y"), F.lit(1.0).alias("s")).repartition(70).cache()
    w, v = np.random.default_rng(3).normal(size=(2, 2 + index.width + 1))
    direct = SP._Rows(rows, 2, index.width, "log")
    want = [*direct.point(w), direct.product(w, v)]
    monkeypatch.setattr(SP, "BLOCK", 4)
    monkeypatch.setattr(SP, "DIRECT_BYTES", 0)
    blocks = SP._Rows(rows, 2, index.width, "log")
    for a, b in zip(want, [*blocks.point(w), blocks.product(w, v)]):
        assert np.allclose(a, b)


def test_models_over_many_levels_predict_the_same(spark, monkeypatch):
    df, _ = coded(spark)
    rows = df.select("id", "a", "b", F.col("x")[0].alias("x0"), F.when(F.col("id") % 11 > 0, F.col("x")[1]).alias("x1"), "label")
    train, test = rows.where("id < 300"), rows.where("id >= 300")
    for name in ("logistic_regression", "linear_svm"):
        spec = next(m for m in MD.MODEL_SPECS if m.name == name)
        want = {r.id: (r.p, r.pred) for r in MD.fit_predict(spec, train, test, ["x0", "x1"], ["a", "b"], "label", "id").collect()}
        with monkeypatch.context() as m:
            m.setattr(MD, "DENSE_LEVELS", 0)
            got = {r.id: (r.p, r.pred) for r in MD.fit_predict(spec, train, test, ["x0", "x1"], ["a", "b"], "label", "id").collect()}
        assert got.keys() == want.keys()
        for k, (p, pred) in want.items():
            assert got[k][1] == pred and (p is None or got[k][0] == pytest.approx(p, abs=1e-5))


def test_a_hundred_thousand_levels(spark):
    n = 200_000
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(n).select(
        F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(100_000)).cast("string")).alias("a"), F.array(noise).alias("x"),
        F.when(F.pmod(F.col("id") * 7919, F.lit(100_000)) % 2 == 0, (noise > 0.2).cast("int")).otherwise((noise > 0.8).cast("int")).alias("label"))
    index = SP.index_levels(df, ["a"])
    assert index.width == 100_000
    rows = SP.encode(df, index).cache()
    model = SP.fit_sparse(rows, index.width, 1.0)
    assert model.gradient <= TOLERANCE and model.level.shape == (100_000,)
    # at the optimum the weights are minus C times the summed slopes of their own rows
    p = 1 / (1 + F.exp(-F.col("margin")))
    slopes = model.margin(rows).select(F.col("levels")[0].alias("idx"), (F.col("label") - p).alias("r")).groupBy("idx").agg(F.sum("r").alias("r"))
    off = model.level_weights(index).join(slopes, "idx").agg(F.max(F.abs(F.col("weight") - F.col("r"))).alias("off"), F.count("*").alias("n")).first()
    assert off.n == 100_000 and off.off < 1e-3


def test_rows_of_one_task_are_dealt_out_and_shared_by_all_models(spark, monkeypatch):
    df, _ = coded(spark)
    index = SP.index_levels(df, ["a", "b"])
    rows = SP.encode(df, index).coalesce(1).cache()
    flat = rows.select("x", "levels", (F.col("label") * 2.0 - 1).alias("y"), F.lit(1.0).alias("s"))
    want = SP.fit_sparse(rows, index.width, 1.0)
    kept, w = SP._Rows(flat, 2, index.width, "log"), np.random.default_rng(3).normal(size=2 + index.width + 1)
    assert kept.tasks >= spark.sparkContext.defaultParallelism  # a pass used to run in the one task of the scan
    with monkeypatch.context() as m:
        m.setattr(SP, "PART_BYTES", 1 << 7)
        m.setattr(SP, "DIRECT_BYTES", 0)
        m.setattr(SP, "BLOCK", 4)
        many = SP._Rows(flat, 2, index.width, "log")
        assert many.tasks > 64
        for a, b in zip(kept.point(w), many.point(w)):
            assert np.allclose(a, b)
    packs, real = [], SP._blocks
    monkeypatch.setattr(SP, "_blocks", lambda *a: packs.append(1) or real(*a))
    both = SP.fit_sparse_each(rows, index.width, [(1.0, "log"), (0.5, "squared hinge")])
    assert len(packs) == 1 and both[1].gradient <= TOLERANCE
    assert np.allclose(want.level, both[0].level, atol=1e-6) and np.allclose(want.numeric, both[0].numeric, atol=1e-6)


def test_long_vectors_are_fitted_one_model_at_a_time_with_the_same_result(spark, monkeypatch):
    import threading

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([([float(a)], [int(b)], int(a + b % 3 > 1)) for a, b in zip(rng.normal(size=300), rng.integers(0, 40, 300))], "x array<double>, levels array<bigint>, label int").repartition(3)
    models = [(1.0, "log"), (1.0, "squared hinge")]
    want, running, most = SP.fit_sparse_each(df, 40, models), [], []
    fit, lock = SP._newton_cg, threading.Lock()

    def one(*a):
        with lock:
            running.append(1)
            most.append(len(running))
        try:
            return fit(*a)
        finally:
            running.pop()

    monkeypatch.setattr(SP, "_newton_cg", one)
    for name, value in (("APART_BYTES", 0), ("DIRECT_BYTES", 0), ("BLOCK", 8)):
        monkeypatch.setattr(SP, name, value)
    got = SP.fit_sparse_each(df, 40, models)
    assert max(most) == 1
    for a, b in zip(got, want, strict=True):
        assert np.allclose(np.r_[a.numeric, a.level, a.intercept], np.r_[b.numeric, b.level, b.intercept], atol=1e-6)
