import json
import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyguard.session import prepare  # noqa: E402
from tallyguard.sources.arrivals import ARRIVALS  # noqa: E402

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyguard-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def arrival_rows(items, step=10):
    """(provider, payload, version) items as arrival rows, in order."""
    rows = []
    for i, item in enumerate(items):
        provider, payload, version = (*item, None)[:3]
        text = payload if isinstance(payload, (str, type(None))) else json.dumps(payload)
        rows.append((i * step, START + timedelta(seconds=i), provider, version, text))
    return rows


@pytest.fixture(scope="session")
def make_arrivals(spark):
    def make(items, step=10):
        return spark.createDataFrame(arrival_rows(items, step), ARRIVALS)

    return make
