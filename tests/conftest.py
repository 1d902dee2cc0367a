import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    folder = tempfile.mkdtemp(prefix="spark-tests-")
    s = session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "2g",
            "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.local.dir": folder,
        }
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
