"""One session for all tests; tables live in new temporary folders."""

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    at = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"{at}/shared", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.default.parallelism": "2"}
    session = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
