import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsgauge.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", "local[8]", spark__checkpoint__dir=f"file:{tmp_path_factory.mktemp('shared')}", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__sql__shuffle__partitions="8", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Rows of a DataFrame as sorted tuples."""
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=str)
    return collect
