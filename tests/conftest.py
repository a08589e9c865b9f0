import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuscope.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def files(spark):
    def build(*rows):
        """rows: (repo, file_path, language, content)"""
        return spark.createDataFrame(
            list(rows), "repo string, file_path string, language string, content string"
        )

    return build
