"""One local session for all tests."""

import pytest

from kolumna.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
