import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF = os.environ.get("CHECK_SF", "0.001")


@pytest.fixture(scope="session")
def spark():
    from check import session
    s = session(8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"/root/testdata/sf{SF}"


@pytest.fixture(scope="session")
def data(spark):
    from gatewatch.plans.registry import Data
    return Data(spark, "/root/testdata/sf0.01")
