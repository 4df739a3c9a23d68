import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from flowtriage.session import local_session

    return local_session(4, app="tests", memory="6g")


@pytest.fixture
def runs(spark):
    """Build a runs corpus from texts, numbered from 0."""

    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "run_id bigint, text string")

    return build


@pytest.fixture
def sheets(spark):
    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "sheet_id bigint, text string")

    return build


@pytest.fixture
def configs(spark):
    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "config_id bigint, text string")

    return build
