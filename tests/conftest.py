"""One local session for all tests, with the folder that a cluster would share set to a temporary one."""

import pytest
from pyspark.sql import SparkSession

from casewright.session import SETTINGS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = SETTINGS | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
