import pytest

from gradeloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
