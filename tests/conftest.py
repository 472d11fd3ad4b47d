import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from varipair.session import build

    shared = tmp_path_factory.mktemp("shared")
    session = build("tests", 4, partitions=4, **{"spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setCheckpointDir(f"file://{shared}/rdd")
    yield session
    session.stop()
