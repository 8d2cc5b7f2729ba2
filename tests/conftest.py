import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[8]", spark__checkpoint__dir=f"file://{folder}", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def panel(spark):
    """Build a panel from ``{entity: [values from t = 0]}``; None leaves the period out."""

    def make(series, start=0):
        rows = [(e, start + i, float(v)) for e, vs in series.items() for i, v in enumerate(vs) if v is not None]
        return spark.createDataFrame(rows, "entity_id long, t int, amount double")

    return make
