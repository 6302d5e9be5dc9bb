import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from voxelkeel.session import build_session
    s = build_session("tests", "local[8]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "6g",
        "spark__driver__host": "127.0.0.1", "spark__driver__bindAddress": "127.0.0.1"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
