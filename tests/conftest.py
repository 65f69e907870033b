import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from envmon.session import get_session
    ckpt = tempfile.mkdtemp(prefix="envmon-test-ckpt-")  # tests only: no shared folder configured
    s = get_session("local[4]", app="envmon-tests", shuffle_partitions=4,
                    conf={"spark.checkpoint.dir": ckpt, "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mini(spark):
    from tests.mini import mini_tables
    return mini_tables(spark)


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="envmon-test-")
