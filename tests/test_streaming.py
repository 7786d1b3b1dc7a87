"""The streaming unit build equals the batch build on the same raw rows."""

import tempfile

from budgetlens.operators.ingest import build_units
from budgetlens.plans.tables import raw_table
from budgetlens.spec import STANDIN_SPEC
from budgetlens.streaming import stream_units


def test_stream_matches_batch(spark):
    sf = "/root/testdata/sf0.001"
    raw = raw_table(spark, sf)
    src = tempfile.mkdtemp(prefix="bl-stream-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="bl-stream-out-", dir="/tmp")
    raw.filter("unit_id % 2 = 0").write.mode("append").parquet(src)
    raw.filter("unit_id % 2 = 1").write.mode("append").parquet(src)
    q = stream_units(spark, src, out, STANDIN_SPEC, name=f"t{abs(hash(src))}")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    exp = build_units(raw, STANDIN_SPEC)
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0
