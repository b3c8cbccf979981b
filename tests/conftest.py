import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("sitelens-tests")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sitelens-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def site_files(spark):
    import fixtures
    return fixtures.site_files(spark)


@pytest.fixture(scope="session")
def audit(site_files):
    from sitelens.plans.audit import run_audit
    return run_audit(site_files)
