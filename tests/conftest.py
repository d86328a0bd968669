import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from strandflow.session import build_session

    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__autoBroadcastJoinThreshold="1m")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
