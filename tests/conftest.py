from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = str(tmp_path_factory.mktemp("shared"))
    session = (SparkSession.builder
               .master("local[*]")
               .appName("kassa-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    # Tests run without a cluster: the shared folder is set here because the
    # session has none (on a cluster it comes from spark.checkpoint.dir).
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test tables are not available")
    return SF_SMALL
