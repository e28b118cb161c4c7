"""One session for all tests; small inputs are made here, stored tables are read where the machine has them."""

import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

DATA = "/root/testdata/sf0.001"

LOG = (
    "sequence bigint, id string, organization string, namespace string, topic string, event_key string, payload string, content_type string, metadata map<string,string>, timestamp timestamp_ntz, version bigint,"
    " parent_id string, correlation_id string, causation_id string, partition_key string, partition_hash bigint, partition_id bigint, partition_count bigint, partition_strategy string"
)

NAMES = [c.split()[0] for c in LOG.replace("map<string,string>", "map").split(",")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def uid(n: int) -> str:
    return f"00000000-0000-7000-8000-{n:012x}"


START = datetime(2031, 3, 1)


@pytest.fixture(scope="session")
def make_log(spark):
    """Log of the rows given: dicts of the columns that differ from the usual ones."""

    def make(*rows: dict):
        usual = dict(organization="acme", namespace="/x", topic="thing.happened", payload="{}", content_type="application/json", metadata={}, version=1)
        made = []
        for i, row in enumerate(rows, 1):
            n = row.get("sequence", i)
            full = usual | {"sequence": n, "id": uid(n or 0), "event_key": f"k{n}", "timestamp": START + timedelta(minutes=n or 0)} | row
            made.append(tuple(full.get(name) for name in NAMES))
        return spark.createDataFrame(made, LOG)

    return make


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no stored tables here")
    return DATA
