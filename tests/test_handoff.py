"""Hand-off tables follow their input and their settings."""

import pytest

from budgetlens.plans import tables
from budgetlens.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_changed_input_gives_a_new_table(spark, tmp_path):
    path = str(tmp_path)
    spark.range(3).write.parquet(f"{path}/customer.parquet")
    before = tables.fingerprint(spark, path)
    assert tables.fingerprint(spark, path) == before and tables.fingerprint(spark, path, 0.3) != before
    first = tables.materialized(spark, path, "t", lambda: spark.read.parquet(f"{path}/customer.parquet")).count()
    spark.range(5).write.mode("overwrite").parquet(f"{path}/customer.parquet")
    assert tables.fingerprint(spark, path) != before
    assert (first, tables.materialized(spark, path, "t", lambda: spark.read.parquet(f"{path}/customer.parquet")).count()) == (3, 5)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
