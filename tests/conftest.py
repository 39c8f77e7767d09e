import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from quern.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "6g")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def values(spark):
    """Evaluate a column function on a list of strings."""
    def run(build, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        done = rows.select("i", build("x").alias("y")).collect()
        return [row.y for row in sorted(done, key=lambda row: row.i)]
    return run
