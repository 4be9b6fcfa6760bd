import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="setsift-test-shared-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def demo_scores(spark):
    from fixtures import DEMO_SCORES, DEMO_TEXTS

    rows = [(cid, text, out, *DEMO_SCORES[cid]) for cid, text, out in DEMO_TEXTS]
    return spark.createDataFrame(
        rows,
        "case_id long, text string, outcome int, dissatisfaction_score double, "
        "policy_demand_score double, coproduction_request_score double",
    )
