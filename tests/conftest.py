import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests", shuffle_partitions=8,
        **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
           "spark.default.parallelism": "2", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
