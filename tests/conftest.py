import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    session = local_session(partitions=4, **{"spark.sql.warehouse.dir": f"file://{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
