import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from policylake.session import build_session  # noqa: E402
from policylake.streaming.throttle import ROCKSDB  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.log.level": "ERROR",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    })
    yield session
    session.stop()


def one(df, *columns):
    """First row as a tuple of the named columns."""
    row = df.select(*columns).first()
    return tuple(row)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
