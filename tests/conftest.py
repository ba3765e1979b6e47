import sys

import pytest
from pyspark.sql import SparkSession

from support import CLAIM, ROOT

sys.path.insert(0, str(ROOT))

from claimspan.functions.bizcal import BusinessCalendar  # noqa: E402
from claimspan.schemas import CLAIMS_WITH_DURATIONS  # noqa: E402
from claimspan.session import configured  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configured(
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
    ).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def calendar(spark):
    return BusinessCalendar()


@pytest.fixture(scope="session")
def claims_of(spark):
    """A claims table from changes to CLAIM, one row each; columns not named are null."""
    def make(*changes):
        rows = [{**CLAIM, "claim_num": n, **change} for n, change in enumerate(changes, 1)]
        cells = [tuple(row.get(name) for name in CLAIMS_WITH_DURATIONS.names) for row in rows]
        return spark.createDataFrame(cells, CLAIMS_WITH_DURATIONS)
    return make
