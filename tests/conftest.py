import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docketry.session import session

    conf = {"spark__master": "local[8]", "spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__driver__memory": "6g", "spark__ui__showConsoleProgress": "false"}
    made = session("tests", **conf, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
