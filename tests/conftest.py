import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from docloom.session import build_session  # noqa: E402
from docloom.streaming.sessions import ROCKSDB  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("checkpoint")
    session = build_session(
        "tests", "4",
        **{
            "spark.checkpoint.dir": str(work),
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression over literals."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
