"""The shared folder is taken from the session, with its scheme."""

import pytest
from pyspark.sql import functions as F

from logweir import session


def test_written_tables_are_below_the_shared_folder(spark):
    folder = session.shared_dir(spark)
    assert folder.startswith("file:") and spark.sparkContext.getCheckpointDir() is not None
    df = session.written(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and all(f.startswith("file:") and "/logweir/t-" in f for f in df.inputFiles())
    assert session.scratch(spark, "a") != session.scratch(spark, "a")


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Cluster())
