import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from brindle.session import local_session

    s = local_session(4, memory="4g", partitions=4, **{"spark.sql.warehouse.dir": "/tmp/brindle-test-warehouse"})
    yield s
    s.stop()


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
