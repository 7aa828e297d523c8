import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_check import connect, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    return connect(sf)


@pytest.fixture
def series(spark):
    """Make an ordered series from values: columns t, t_idx, y and more."""
    def make(values, **more):
        rows = [(i, float(v) if v is not None else None, *[c[i] for c in more.values()]) for i, v in enumerate(values)]
        extra = "".join(f", {c} double" for c in more)
        df = spark.createDataFrame(rows, f"t_idx bigint, y double{extra}")
        return df.selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(t_idx as int) * 600) as t", "*")

    return make
