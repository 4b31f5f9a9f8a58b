import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tablemove-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tm-wh-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from tablemove.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


@pytest.fixture()
def ns(spark, tmp_path):
    """A fresh namespace located in the test's temp folder."""
    from tablemove.operators.write import ensure_namespace
    from tablemove.session import unique_name

    name = unique_name("t")
    ensure_namespace(spark, name, str(tmp_path / f"{name}.db"))
    return name
