import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from driftloom.session import local_session, ship

    session = local_session(cpus=4, partitions=4, memory="3g")
    session.conf.set("spark.sql.ansi.enabled", "true")
    ship(session)
    yield session
    session.stop()
