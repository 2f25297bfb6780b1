import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driftgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "driftgauge-tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def spread(spark):
    """Forces the plans for keys too large for one task."""
    spark.conf.set("spark.driftgauge.singleTaskRows", "20")
    yield spark
    spark.conf.unset("spark.driftgauge.singleTaskRows")
