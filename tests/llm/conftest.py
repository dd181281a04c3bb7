import pytest
from llm_support import ODD_ROWS, frame


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, ODD_ROWS[:1]).limit(0)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from citeloom.llm.common import ship

    ship(spark)
