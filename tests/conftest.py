import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.plans.runtime import build_session

    session = build_session("tests", cpus="4", shuffle_partitions=4, driver_memory="3g")
    yield session
    session.stop()
