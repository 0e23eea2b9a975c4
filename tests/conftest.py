import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhouse.plans.shop import Shop  # noqa: E402
from tallyhouse.session import session_builder  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = session_builder("tests").master("local[8]") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false") \
        .config("spark.driver.memory", "8g") \
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyhouse-tests-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    return Shop(spark, DATA)


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")
