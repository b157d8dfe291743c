import tempfile

import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-ckpt-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tessera-warehouse-"),
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
