import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("plumbline-tests", 8)


@pytest.fixture
def one(spark):
    """Evaluate a column on a single row."""

    def run(column):
        return spark.range(1).select(column.alias("x")).first().x

    return run
