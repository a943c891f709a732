import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from driftwell.session import local_session

    session = local_session("4", partitions=4, memory="3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
