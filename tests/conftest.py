import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (registers the package to travel with tasks)
    from abacist.session import build

    session = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                   "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
