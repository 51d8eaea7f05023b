import os
import sys

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fundspark.session import local_session

    s = local_session(4, 4, "6g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
