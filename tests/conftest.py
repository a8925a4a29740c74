import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quadrille.plans.session import local_session
    s = local_session("*", app="quadrille-tests", **{"spark.sql.shuffle.partitions": "8",
                                                      "spark.driver.memory": "8g"})
    yield s


@pytest.fixture
def tmp_out(tmp_path):
    return str(tmp_path)
